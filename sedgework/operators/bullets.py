"""Lines of text, their quality features, and the scores of their pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions import text as X
from sedgework.functions import values as V


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each line: ``ord`` from 0, ``line``; null texts have none. Other columns stay."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(F.split(text, "\n")).alias("ord", "line"))


def bullets(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines without markers, of more than five characters, as ``bullet``."""
    return lines(df, text).withColumn("bullet", X.bullet_text(F.col("line"))).where(F.length("bullet") >= V.BULLET_MIN_CHARS).drop("line")


def features(bullet_rows: DataFrame) -> DataFrame:
    """Add has_metric, verb_led, words and in_window to rows with ``bullet``."""
    b = F.col("bullet")
    out = bullet_rows.withColumns({"has_metric": X.has_metric(b), "verb_led": X.starts_with_verb(b), "words": X.count_words(b)})
    return out.withColumn("in_window", F.col("words").between(V.BULLET_MIN_WORDS, V.BULLET_MAX_WORDS))


def pool_scores(feature_rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and scores of each pool of bullets.

    ``specificity`` is full when six bullets in ten are quantified; ``structure`` averages half a credit
    for the verb and half for the length. A pool of fewer than three bullets gets no points.
    """
    n = lambda c: F.sum(F.col(c).cast("bigint"))
    pool = feature_rows.groupBy(*keys).agg(F.count("*").alias("total"), n("has_metric").alias("metric"), n("verb_led").alias("verb_led"), n("in_window").alias("in_window"))
    spec = F.least(F.lit(100), X.floor_half(F.col("metric") / F.col("total") / V.SPECIFICITY_TARGET * 100)).cast("bigint")
    struct = X.floor_half((F.col("verb_led") * 0.5 + F.col("in_window") * 0.5) / F.col("total") * 100).cast("bigint")
    pool = pool.withColumns({"specificity": spec, "structure": struct})
    graded = F.col("total") >= V.MIN_BULLETS_TO_GRADE
    points = X.floor_half(F.col("specificity") / 100 * 40) + X.floor_half(F.col("structure") / 100 * 30)
    pool = pool.withColumn("points", F.when(graded, points).otherwise(F.lit(0)).cast("bigint"))
    pool = pool.withColumn("overall", X.floor_half(F.col("points") / 70 * 100).cast("bigint"))
    return pool.withColumn("tier", X.tier(F.col("overall")))


def bullet_ids(bullet_rows: DataFrame, group: str, order: str = "ord") -> DataFrame:
    """A stable id, ``<occurrence>|<key>``: equal lines of a group are numbered in order."""
    rows = bullet_rows.withColumn("key", X.bullet_key(F.col("bullet")))
    nth = F.row_number().over(Window.partitionBy(group, "key").orderBy(order)) - 1
    return rows.withColumn("bullet_id", F.concat_ws("|", nth.cast("string"), "key")).drop("key")


def free_ids(texts: DataFrame, claimed: DataFrame, group: str, order: str = "ord") -> DataFrame:
    """As ``bullet_ids``, but the occurrence skips the numbers of ``claimed`` (group, key, occurrence).

    The n-th occurrence takes the n-th number that is not claimed: with the claimed numbers in an
    ascending array, claim number i is skipped once fewer than i free numbers are below it.
    """
    rows = texts.withColumn("key", X.bullet_key(F.col("bullet")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(group, "key").orderBy(order)) - 1)
    taken = claimed.groupBy(group, "key").agg(F.sort_array(F.collect_set("occurrence")).alias("taken"))
    skip = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("nth"), lambda at, t: F.when(t <= at, at + 1).otherwise(at))
    return rows.join(taken, [group, "key"], "left").withColumn("bullet_id", F.concat_ws("|", skip.cast("string"), "key")).drop("key", "nth", "taken")


def owners(bullet_rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Each bullet with the entry that owns its text; of several the smallest ``entry_id``; null if none.

    ``entries`` has entry_id and line. The owner of a text is one partial aggregate, so a text that
    many entries share costs no more than one row for each map task.
    """
    first = entries.select(X.bullet_key(F.col("line")).alias("key"), "entry_id").groupBy("key").agg(F.min("entry_id").alias("entry_id"))
    return bullet_rows.withColumn("key", X.bullet_key(F.col("bullet"))).join(first, "key", "left").drop("key")


def strip_boilerplate(line_rows: DataFrame, group: str, anchors: tuple[str, ...] = V.BOILERPLATE_ANCHORS) -> DataFrame:
    """Drop lines with an anchor and the lines after them up to the next blank line, which stays."""
    low = F.regexp_replace(F.lower(F.trim("line")), "\\s+", " ")
    anchored = F.lit(False)
    for a in anchors:
        anchored = anchored | low.contains(a)
    state = F.when(anchored, True).when(low == "", False)
    before = Window.partitionBy(group).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = line_rows.withColumn("skipping", F.coalesce(F.last(state, ignorenulls=True).over(before), F.lit(False)))
    return rows.where(~F.col("skipping")).drop("skipping")


def headers(line_rows: DataFrame, group: str) -> DataFrame:
    """Carry each short header line (40 characters, four words, no closing punctuation) forward.

    Adds ``is_header`` and ``section`` (the last header's text so far, null before the first).
    """
    line = F.trim("line")
    short = (F.length(line).between(1, 40)) & (F.size(X.tokens(line)) <= 4) & ~line.rlike("[.!?;,:]$") & ~line.rlike(V.BULLET_MARKER)
    upto = Window.partitionBy(group).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return line_rows.withColumn("is_header", short).withColumn("section", F.last(F.when(F.col("is_header"), line), ignorenulls=True).over(upto))


def weighted_mode(rows: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """The value of the largest summed weight in each group, the smallest value among ties."""
    sums = rows.groupBy(group, value).agg(F.sum(weight).alias("w"))
    best = F.max(F.struct(F.col("w"), (-F.col(value)).alias("v")))
    return sums.groupBy(group).agg(best.alias("b")).select(group, (-F.col("b.v")).alias("mode"), F.col("b.w").alias("weight"))


def marked_bullets(line_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, bullet) of lines (ord, line) that begin with a mark or a number; a mark alone takes the next line as its text.

    A line that a mark has taken is no bullet of its own: of several marks in a row every other takes the next.
    """
    part = Window.partitionBy(*keys).orderBy("ord")
    rows = line_rows.withColumn("__lone", F.coalesce(F.col("line").rlike(V.LONE_BULLET), F.lit(False))).withColumns({"__next": F.lead("line").over(part), "__i": F.row_number().over(part)})
    last = F.coalesce(F.max(F.when(~F.col("__lone"), F.col("__i"))).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # in a run of lone marks the first, third, ... take the line behind them
    takes = F.col("__lone") & ((F.col("__i") - last) % 2 == 1)
    rows = rows.withColumn("__takes", takes)
    taken = F.coalesce(F.lag("__takes").over(part), F.lit(False))
    text = F.when(F.col("__takes"), F.concat_ws(" ", F.rtrim("line"), F.trim("__next"))).otherwise(F.col("line"))
    rows = rows.withColumns({"__text": text, "__taken": taken}).where(~F.col("__taken") & ~(F.col("__takes") & F.col("__next").isNull()))
    marked = F.regexp_replace("__text", V.BULLET_MARKER, "")
    bullet = F.trim(F.when(marked != F.col("__text"), marked).otherwise(F.regexp_replace("__text", V.NUMBERED_BULLET, "")))
    found = rows.withColumn("bullet", F.when(F.col("__text").rlike(V.BULLET_MARKER) | F.col("__text").rlike(V.NUMBERED_BULLET), bullet))
    return found.where(X.count_words(F.col("bullet")) >= 1).select(*keys, "ord", "bullet")
