"""Names and headlines from the first lines of documents: candidates, points, and the best of each document.

Each of the first lines is a candidate, and so are two single words one under the other. Points come from place,
size, case, words and the distance to the contact data; the document's best candidate is one aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions import shapes as H
from sedgework.functions import values as V
from sedgework.functions.dates import let
from sedgework.operators.entries import once, sure
from sedgework.operators.sections import section_of


def words_of(text: Column) -> Column:
    return F.split(text, "\\s+")


def is_boilerplate(text: Column) -> Column:
    """Words that title a document: all of them, or two of up to three."""
    bare = F.transform(words_of(text), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    hits = F.size(F.filter(bare, lambda w: w.isin(*V.NAME_BOILERPLATE)))
    return (hits > 0) & ((hits == F.size(bare)) | ((F.size(bare) <= 3) & (hits >= 2)))


def is_section(text: Column) -> Column:
    return section_of(text)["section"].isNotNull()


def is_name_word(text: Column) -> Column:
    t = F.trim(text)
    return F.length(t).between(1, 30) & t.rlike(V.NAME_WORD) & ~is_section(t) & ~is_boilerplate(t)


def names(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, confidence) of the documents that have a candidate.

    ``lines`` (keys, ord, text, font, y) are those above a document's first section. A lone word is a candidate only as the first that could be
    one, in nearly the largest font. Of equal candidates the first wins. Null texts are no candidates.
    """
    return _best(lines, keys).select(*keys, "name", "confidence")


def _best(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``names``, with the first lines of each document in order: ord, text, ends (a section, contact data or an address) and may (reads like a headline)."""
    part = Window.partitionBy(*keys)
    order = part.orderBy("ord")
    t = F.trim("text")
    rows = lines.select(*keys, "ord", F.coalesce("text", F.lit("")).alias("text"), F.col("font").cast("double").alias("font"), F.col("y").cast("double").alias("y"))
    rows = once(rows, word=sure(is_name_word(F.col("text"))), reached=sure(H.has_contact(F.col("text"))))
    contact = F.min(F.when(F.col("reached"), F.struct("ord", "y"))).over(part)["y"]
    ahead = {f"next{e}": F.lead(c).over(order) for e, c in (("", "text"), ("_font", "font"), ("_word", "word"))}
    rows = rows.withColumns({"n": F.row_number().over(order) - 1, "largest": F.max("font").over(part), "usual": F.avg("font").over(part), "contact": contact} | ahead)
    rows = rows.where(F.col("n") < V.NAME_LINES)
    caps = lambda x: sure(F.regexp_replace(x, "[^A-Za-z]", "").rlike(".") & (x == F.upper(x)))
    pair = (F.col("n") <= 1) & sure(F.col("word") & F.col("next_word"))
    rows = once(rows, ends=sure(stops_headline(t)), may=sure(may_be_headline(t)))
    rows = rows.withColumn("lines", F.collect_list(F.struct("ord", t.alias("text"), "ends", "may")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    alone = F.struct((F.col("n") * 2).alias("at"), t.alias("text"), F.col("font").alias("font"), caps(F.col("text")).alias("caps"))
    both = F.struct((F.col("n") * 2 + 1).alias("at"), F.concat_ws(" ", t, F.trim("next")).alias("text"), F.greatest("font", "next_font").alias("font"), caps(F.col("text")).alias("caps"))
    found = rows.select(*keys, "n", "y", "largest", "usual", "contact", "lines", F.explode(F.array_compact(F.array(alone, F.when(pair, both)))).alias("c")).select("*", "c.*")
    text, words = F.col("text"), F.col("words")
    found = once(found, words=words_of(text), title=H.looks_like_title(text))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.greatest(F.length(text), F.lit(1))
    fits = F.length(text).between(1, V.NAME_CHARS) & ~text.rlike("[0-9@]") & (F.size(words) <= V.NAME_WORDS) & (letters >= V.NAME_LETTERS) & ~is_boilerplate(text) & ~H.has_word(text, V.SCHOOL_WORDS)
    lone = F.size(words) == 1
    mononym = ~is_section(text) & ~F.col("title") & text.rlike(V.NAME_WORD) & (F.col("font") >= F.col("largest") - 0.5)
    found = found.where(fits & (~lone | mononym)).withColumn("first", F.min("at").over(part))
    found = found.where(~lone | (F.col("at") == F.col("first")))
    leads = F.col("n") == F.floor(F.col("first") / 2)
    near = sure(F.abs(F.col("y") - F.col("contact")) < V.CONTACT_NEAR)
    points = V.NAME_POINTS
    tests = [
        (leads, points["first"]), (F.col("font") >= F.col("largest") - 0.5, points["largest"]), (F.col("font") > F.col("usual") + 1, points["large"]), (F.col("caps") | F.forall(words, lambda w: w.rlike(V.NAME_WORD)), points["cased"]),
        (F.size(words).between(2, 4), points["words"]), (near & leads, points["near_first"]), (near & ~leads, points["near_later"]), (F.col("title"), points["title"]), (lone, points["mononym"]),
    ]
    score = F.round(reduce(lambda a, b: a + b, [F.when(sure(c), F.lit(p)).otherwise(0.0) for c, p in tests]), 6)
    best = F.max(F.struct(score.alias("score"), (-F.col("at")).alias("early"), "text"))
    return found.groupBy(*keys).agg(best.alias("b"), F.first("lines").alias("lines")).select(*keys, F.col("b.text").alias("name"), F.least(F.col("b.score"), F.lit(1.0)).alias("confidence"), "lines")


def stops_headline(text: Column) -> Column:
    return (text != "") & (is_section(text) | H.has_contact(text) | text.contains("@") | text.rlike("(?i)https?://"))


def may_be_headline(text: Column) -> Column:
    return (text != "") & (F.length(text) <= V.HEADLINE_CHARS) & H.looks_like_title(text)


def names_and_headlines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, confidence, headline) of the documents that have a name: ``names`` and ``headlines`` in one pass over the lines."""
    named = lambda x: sure(F.lower(F.trim("name")).contains(F.lower(x["text"])))
    end = F.get(F.filter("lines", lambda x: x["ends"] & ~named(x)), 0)["ord"]
    first = lambda end: F.get(F.filter("lines", lambda x: x["may"] & ~named(x) & (end.isNull() | (x["ord"] < end))), 0)["text"]
    return _best(lines, keys).select(*keys, "name", "confidence", let(end, first).alias("headline"))


def headlines(lines: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, headline, confidence): the first of a document's first lines that reads like a title, above any section or contact data.

    ``found`` are the ``names``; a line that the name holds is no headline, nor is one of more than 60 characters.
    """
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys])
    rows = lines.select(*keys, "ord", F.trim(F.coalesce("text", F.lit(""))).alias("text")).alias("l").join(found.select(*keys, "name").alias("f"), same, "left").select("l.*", "f.name")
    order = Window.partitionBy(*keys).orderBy("ord")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= V.NAME_LINES)
    named = sure(F.lower(F.trim("name")).contains(F.lower("text")))
    ends = ~named & stops_headline(F.col("text"))
    rows = rows.withColumns({"over": F.max(sure(ends)).over(order), "named": named})
    may = ~F.col("over") & ~F.col("named") & may_be_headline(F.col("text"))
    return rows.where(may).groupBy(*keys).agg(F.min_by("text", "ord").alias("headline")).withColumn("confidence", F.lit(V.HEADLINE_CONFIDENCE))
