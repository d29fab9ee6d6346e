"""Rules over records that are told to a person: lines that want work, pairs that may be merged, entries whose dates don't agree, parses without text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.functions import dates as T
from sedgework.functions import shapes as H
from sedgework.functions import text as X
from sedgework.functions import values as V


def needs_attention(has_metric: Column, verb_led: Column, words: Column) -> Column:
    """A line that isn't quantified, doesn't begin with a verb, or is too short or too long."""
    return ~(has_metric & verb_led & words.between(V.BULLET_MIN_WORDS, V.BULLET_MAX_WORDS))


def without_owned_lines(lines: DataFrame, titles: DataFrame, line: str, title: str) -> DataFrame:
    """``lines`` but for those that a title of an entry owns, with or without a label before it: two anti joins on keys."""
    keys = titles.select(H.title_key(F.col(title)).alias("__own")).where("__own <> ''").distinct()
    rows = lines.withColumn("__key", H.title_key(F.col(line))).withColumn("__rest", H.without_label(F.col("__key")))
    rows = rows.join(keys, F.col("__key") == F.col("__own"), "left_anti").join(keys, F.col("__rest") == F.col("__own"), "left_anti")
    return rows.drop("__key", "__rest")


def without_header_lines(lines: DataFrame, roles: DataFrame, key: str, line: str) -> DataFrame:
    """``lines`` but for those that only say the head of a role (title, company, place, team) of the same ``key`` again."""
    keys = roles.select(key, F.explode(H.header_keys(*map(F.col, ("title", "company", "place", "team")))).alias("__key")).distinct()
    return lines.withColumn("__key", X.flat(F.col(line))).join(keys, [key, "__key"], "left_anti").drop("__key")


def actionable(confidence: Column) -> Column:
    """Whether a pair of duplicates is sure enough to be merged."""
    return F.coalesce(*[F.when(confidence == k, F.lit(v)) for k, v in V.DUPLICATE_RANKS.items()]) >= V.DUPLICATE_RANKS["probable"]


def suppressed(confidence: Column, a: Column, b: Column) -> Column:
    """Whether a pair is hidden: both sides are of one cluster of reposts, and it isn't certain."""
    return (confidence != "certain") & F.coalesce(a == b, F.lit(False))


def pair_actions(pairs: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """Adds actionable and suppressed to ``pairs`` (a, b, confidence); ``clusters`` has the key of a record and its cluster."""
    both = pairs.join(clusters.select(F.col(key).alias("a"), F.col("cluster").alias("__a")), "a", "left").join(clusters.select(F.col(key).alias("b"), F.col("cluster").alias("__b")), "b", "left")
    return both.withColumns({"actionable": actionable(F.col("confidence")), "suppressed": suppressed(F.col("confidence"), F.col("__a"), F.col("__b"))}).drop("__a", "__b")


def entry_checks(entries: DataFrame, key: str, year: int) -> DataFrame:
    """(key, entries, ends_before_start, student, short_career) of each record's entries (start, end): an end before its start, a school year of
    late (by ``year``), many entries in too few years."""
    started = T.year_of(F.col("start")).cast("int")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return entries.groupBy(key).agg(
        F.count("*").alias("entries"), any_(T.month_number(F.col("end")) < T.month_number(F.col("start"))).alias("ends_before_start"), any_(T.year_of(F.col("end")).cast("int") >= year - V.STUDENT_YEARS).alias("student"),
        ((F.count(started) >= V.CAREER_ENTRIES) & (F.max(started) - F.min(started) < V.CAREER_YEARS)).alias("short_career"),
    )


def no_text(scanned: Column, text: Column) -> Column:
    """Whether there is no text to judge a parse by."""
    return scanned | (F.trim(F.coalesce(text, F.lit(""))) == "")


def unreadable(scanned: Column, text: Column) -> Column:
    return no_text(scanned, text) | (F.length(F.coalesce(text, F.lit(""))) == 0)


def newest(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """The newest rows, ties by key."""
    return rows.orderBy(F.desc(at), key).limit(most)
