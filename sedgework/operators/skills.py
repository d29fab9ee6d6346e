"""Skills by their aliases: mentions in texts, the terms of a posting and how far a text covers them.

A dictionary is a list of (id, label, aliases). It is a literal of the plan, so it must be small (some
hundreds of aliases): a text is read once and nothing is shuffled before the counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.functions import text as X
from sedgework.functions import values as V

Dictionary = list[tuple[str, str, list[str]]]


def alias_index(skills: Dictionary) -> dict[str, str]:
    """Alias in lower case to id; the later entry has a doubled alias."""
    return {a.lower(): name for name, _, aliases in skills for a in aliases}


def alternatives(phrases: list[str]) -> str:
    """A pattern of phrases; longer ones first, so that a phrase wins against its beginning."""
    return "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))


def mentions(df: DataFrame, key: str, text: str, skills: Dictionary) -> DataFrame:
    """(key, skill, label, n): how often each text mentions each skill; a place counts for its longest alias."""
    index = alias_index(skills)
    found = F.regexp_extract_all(F.lower(text), F.lit(f"(?:^|{V.ALIAS_EDGE})({alternatives(list(index))})(?=$|{V.ALIAS_EDGE})"), 1)
    to_id = F.create_map(*[F.lit(x) for pair in index.items() for x in pair])
    labels = F.create_map(*[F.lit(x) for name, label, _ in skills for x in (name, label)])
    rows = df.where(F.col(text).isNotNull()).select(key, F.explode(found).alias("alias")).select(key, F.element_at(to_id, F.col("alias")).alias("skill"))
    return rows.groupBy(key, "skill").agg(F.count("*").alias("n")).withColumn("label", F.element_at(labels, F.col("skill")))


def mentioned(text: Column, phrases: list[str]) -> Column:
    """Whether one of some phrases stands in a text (in lower case)."""
    return text.rlike(f"(?:^|{V.ALIAS_EDGE})(?:{alternatives([p.lower() for p in phrases])})(?:$|{V.ALIAS_EDGE})")


def coverage(df: DataFrame, text: str, terms: str, skills: Dictionary) -> DataFrame:
    """covered, missing (names in order) and score (0 to 100) of each text against its ``terms``.

    ``terms`` is an array of (name, source): a skill counts where one of its aliases stands in the text,
    a noun phrase where it does itself; skills weigh 1, nouns a half. No terms: score 0.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    known = F.create_map(*[F.lit(x) for name, _, aliases in skills for x in (name, f"(?:^|{V.ALIAS_EDGE})(?:{alternatives([a.lower() for a in aliases])})(?:$|{V.ALIAS_EDGE})")])
    quoted = lambda p: F.regexp_replace(F.lower(p), "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")
    pattern = lambda t: F.when(t["source"] == "skill", F.element_at(known, t["name"])).otherwise(F.concat(F.lit(f"(?:^|{V.ALIAS_EDGE})"), quoted(t["name"]), F.lit(f"(?:$|{V.ALIAS_EDGE})")))
    judged = F.transform(F.col(terms), lambda t: F.struct(t["name"].alias("name"), F.when(t["source"] == "skill", V.SKILL_WEIGHT).otherwise(V.NOUN_WEIGHT).alias("weight"), F.coalesce(F.regexp_like(F.col("__low"), pattern(t)), F.lit(False)).alias("hit")))
    rows = df.withColumn("__low", low).withColumn("__judged", F.explode(F.array(judged))).drop("__low")  # exploded, so that it is computed once
    part = lambda hit: F.filter("__judged", lambda t: t["hit"] == hit)
    weight = lambda a: F.aggregate(a, F.lit(0.0), lambda s, t: s + t["weight"])
    names = lambda a: F.array_join(F.transform(a, lambda t: t["name"]), ",")
    total = weight(F.col("__judged"))
    score = F.when(total > 0, X.floor_half(weight(part(True)) / total * 100)).otherwise(0).cast("int")
    return rows.withColumns({"covered": names(part(True)), "missing": names(part(False)), "score": score}).drop("__judged")
