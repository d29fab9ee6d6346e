"""Queries over skills; frequent words of the texts stand for a dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgework.functions import values as V
from sedgework.operators import coherence as Y
from sedgework.operators import dictionary as D
from sedgework.operators import skills as K
from sedgework.plans import sql
from sedgework.plans.registry import Registry
from sedgework.sources.tables import table

R = Registry()
SKILLS = [("article", "Article", ["the", "les", "las", "der"]), ("of-the", "Of / The", ["of the", "of thing", "the of"]), ("joint", "Joint", ["and", "und", "et", "and the"]), ("thing", "Thing", ["thing", "ththing"]), ("c++", "C++", ["c++", "with"]), ("none", "None", ["no such word here"])]
NOUNS = ["that", "para", "a.b"]
_INDEX = K.alias_index(SKILLS)
_E = V.ALIAS_EDGE
#: Each edge is doubled, so that neighbouring mentions don't share one.
_TWICE = f"regexp_replace(lower(text), {sql.q('(' + _E + ')')}, '\\1\\1', 'g')"
_ALT = "(" + "|".join(a.replace("+", "\\+").replace(" ", "  ") for a in sorted(_INDEX, key=lambda p: (-len(p), p))) + ")"
_CASES = " ".join(f"WHEN {sql.q(a.replace(' ', '  '))} THEN {sql.q(i)}" for a, i in _INDEX.items())
_LABELS = " ".join(f"WHEN {sql.q(i)} THEN {sql.q(label)}" for i, label, _ in SKILLS)


@R.query(f"""SELECT doc_id, skill, CASE skill {_LABELS} END AS label, count(*) AS n FROM (SELECT doc_id, CASE a {_CASES} END AS skill FROM (
  SELECT doc_id, unnest(regexp_extract_all({_TWICE}, {sql.q('(?:^|' + _E + ')' + _ALT + '(?:$|' + _E + ')')}, 1)) AS a FROM documents)) GROUP BY doc_id, skill""")
def skill_mentions(spark, sf):
    """How often each document mentions each entry of the dictionary, the longest alias at a place."""
    return K.mentions(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", SKILLS)


def _has(s: str, phrases: list[str]) -> str:
    alt = "|".join(p.replace("+", "\\+").replace(".", "\\.") for p in phrases)
    return sql.has(s, f"(?:^|{_E})(?:{alt})(?:$|{_E})")


_TERMS = [(i, "skill", V.SKILL_WEIGHT, a) for i, _, a in SKILLS] + [(n, "noun", V.NOUN_WEIGHT, [n]) for n in NOUNS]
_WANTED = "\nUNION ALL ".join(f"SELECT item_id, {k} AS k, {sql.q(n)} AS name, {w} AS w FROM (SELECT item_id, lower(text) AS low FROM benchmark) WHERE {_has('low', a)}" for k, (n, _, w, a) in enumerate(_TERMS))
_HIT = "CASE name " + " ".join(f"WHEN {sql.q(n)} THEN {_has('low', a)}" for n, _, _, a in _TERMS) + " END"


@R.query(f"""SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY k) FILTER (hit), '') AS covered, coalesce(string_agg(name, ',' ORDER BY k) FILTER (NOT hit), '') AS missing,
  CAST(coalesce(floor(coalesce(sum(w) FILTER (hit), 0) / sum(w) * 100 + 0.5), 0) AS INTEGER) AS score FROM (
  SELECT doc_id, k, name, w, coalesce({_HIT}, false) AS hit FROM (SELECT doc_id, lower(coalesce(text, '')) AS low, doc_id % 40 AS item_id FROM documents) LEFT JOIN ({_WANTED}) USING (item_id)) GROUP BY doc_id""")
def skill_coverage(spark, sf):
    """Each document against the terms of one item of the benchmark (skills and noun phrases that it mentions)."""
    low = F.lower("text")
    found = [F.when(K.mentioned(low, a), F.struct(F.lit(n).alias("name"), F.lit(source).alias("source"))) for n, source, _, a in _TERMS]
    wanted = table(spark, sf, "benchmark").select("item_id", F.array_compact(F.array(*found)).alias("terms"))
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id")).join(wanted, "item_id", "left")
    empty = F.array().cast("array<struct<name:string,source:string>>")
    return K.coverage(docs.withColumn("terms", F.coalesce("terms", empty)), "text", "terms", SKILLS).select("doc_id", "covered", "missing", "score")


def benchmark_dictionary(spark, sf):
    """(alias, skill, label): the words of five letters or more of all benchmark items, and pairs of neighbouring words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2,})"), 1)
    items = table(spark, sf, "benchmark").select(F.explode(F.array(words)).alias("w"))
    single = items.select(F.explode("w").alias("alias")).where(F.length("alias") >= 5)
    pairs = items.where(F.size("w") > 1).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).alias("alias"))
    return single.union(pairs).distinct().select("alias", F.substring("alias", 1, 4).alias("skill"), F.initcap(F.substring("alias", 1, 4)).alias("label"))


@R.query()
def dictionary_mentions(spark, sf):
    """How often each document mentions each skill of a dictionary that is a table."""
    return D.mentions(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", benchmark_dictionary(spark, sf))


@R.query()
def posting_terms(spark, sf):
    """What each document asks for, by the same dictionary, without doubtful matches."""
    return D.terms(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", benchmark_dictionary(spark, sf))


@R.query()
def search_verdicts(spark, sf):
    """Every customer's search (names of parts as titles, kinds of parts as skills) against profiles of all brands."""
    p = table(spark, sf, "part")
    kind = F.concat_ws(" ", "p_type", (F.col("p_size") % 9).cast("string"))
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    profiles = p.groupBy(number.alias("profile")).agg(F.sort_array(F.collect_set("p_name")).alias("titles"), F.sort_array(F.collect_set(kind)).alias("skills"))
    profiles = profiles.withColumn("family", F.when(F.col("profile") % 5 == 0, "leadership").otherwise("other"))
    one = p.select((F.col("p_partkey") % 150).alias("c"), F.concat(F.lit("Senior "), "p_name").alias("title"), kind.alias("skill"))
    asked = one.groupBy("c").agg(F.slice(F.sort_array(F.collect_set("title")), 1, 3).alias("titles"), F.slice(F.sort_array(F.collect_set("skill")), 1, 6).alias("skills"))
    c = table(spark, sf, "customer").withColumn("c", F.col("c_custkey") % 150).join(asked, "c")
    queries = c.select("c_custkey", "titles", "skills", F.array(F.lit("small")).alias("noise"), F.slice("skills", 1, 2).alias("canonical"))
    found = Y.assessed(queries, profiles, "c_custkey")
    shown = lambda c, *fs: F.array_join(F.transform(c, lambda v: F.concat_ws(":", *[v[f] for f in fs])), "|")
    return found.select("c_custkey", shown("verdicts", "kind", "term", "quality").alias("verdicts"), shown("missing", "kind", "term").alias("missing"), "direction", F.array_join("off_axis", "|").alias("off_axis"))
