"""Terms, coverage, votes and ratings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions import text as X
from sedgework.functions import values as V


def coverage(df: DataFrame, text: str, terms: list[tuple[str, float]]) -> DataFrame:
    """Share (0 to 100) of the weight of the dictionary ``terms`` (single tokens) that each text has, and the terms covered.

    The dictionary is a literal of the plan; a text is read once and nothing is shuffled.
    """
    weight = F.create_map(*[F.lit(x) for t, w in terms for x in (t, float(w))])
    hit = F.array_intersect(F.array(*[F.lit(t) for t, _ in terms]), F.split(X.flat(F.col(text)), " "))
    rows = df.withColumn("__hit", F.explode(F.array(hit)))  # exploded, so that a text is split once
    score = X.floor_half(F.aggregate("__hit", F.lit(0.0), lambda s, t: s + F.element_at(weight, t)) / sum(w for _, w in terms) * 100).cast("int")
    return rows.withColumns({"covered": F.array_join("__hit", ","), "n_covered": F.size("__hit"), "score": score}).drop("__hit")


def sector_scores(df: DataFrame, text: str) -> DataFrame:
    """sector, hits, runner_up and confidence of a text.

    A sector's hits are its phrases that occur. The most hits win, the earlier sector among ties;
    without a hit the sector is ``other``. Confidence: the winner's share of its and the runner-up's
    hits, times hits / 3 (at most 1).
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    scored = []
    for k, (name, phrases) in enumerate(V.SECTORS.items()):
        hits = reduce(lambda a, b: a + b, (F.when(low.rlike(f"{X.START}{p}{X.END}"), 1).otherwise(0) for p in phrases))
        scored.append(F.struct(hits.alias("hits"), F.lit(-k).alias("k"), F.lit(name).alias("sector")))
    ranked = F.sort_array(F.array(*scored), asc=False)
    out = df.withColumn("__r", ranked)
    top, second = F.col("__r")[0], F.col("__r")[1]
    hit = top["hits"] >= 1
    return out.withColumns({
        "sector": F.when(hit, top["sector"]).otherwise("other"),
        "hits": top["hits"],
        "runner_up": F.when(hit & (second["hits"] >= 1), second["sector"]),
        "confidence": F.when(hit, top["hits"] / (top["hits"] + second["hits"]) * F.least(F.lit(1.0), top["hits"] / V.CONFIDENT_HITS)).otherwise(F.lit(0.0)),
    }).drop("__r")


def annual_pay(amount: Column, period: Column) -> Column:
    """Pay for a year; null if implausibly low."""
    year = F.when(period == "hour", amount * V.HOURS_PER_YEAR).when(period == "month", amount * V.MONTHS_PER_YEAR).otherwise(amount)
    return F.when(year >= V.LEAST_ANNUAL_PAY, year)


def below_floor(lowest: Column, highest: Column, period: Column, currency: Column, floor: float) -> Column:
    """Whether the best yearly pay in USD is under the floor; false if unknown."""
    best = F.coalesce(highest, lowest)
    year = F.when(period == "hour", best * V.HOURS_PER_YEAR).when(period == "month", best * V.MONTHS_PER_YEAR).otherwise(best)
    return F.coalesce((currency == "USD") & (year < floor), F.lit(False))


def rating(base: Column, pay: Column, floor: float | None, place: Column, distance: Column) -> dict[str, Column]:
    """Stars of each axis and overall; an axis that is null takes no part, its weight goes to the others.

    ``base``: fitness points; ``pay``: yearly top pay or null; ``place``: whether the place matches or
    null; ``distance``: rungs between the levels or null.
    """
    unit = lambda x: F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    axes = {
        "fitness": base / (base + V.FIT_HALF),
        "compensation": unit(pay / floor / 2) if floor else F.lit(0.5) + F.lit(0.5) * (pay / (pay + V.PAY_HALF)),
        "location": F.when(place, F.lit(1.0)).when(~place, F.lit(V.OTHER_PLACE)),
        "seniority": F.when(distance.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(distance) * V.SENIORITY_STEP)),
    }
    w = V.RATING_WEIGHTS
    part = lambda k: F.when(axes[k].isNotNull(), axes[k] * w[k]).otherwise(F.lit(0.0))
    weight = lambda k: F.when(axes[k].isNotNull(), F.lit(w[k])).otherwise(F.lit(0.0))
    whole = reduce(lambda a, b: a + b, map(weight, axes))
    return {"overall": reduce(lambda a, b: a + b, map(part, axes)) / whole * V.MAX_STARS} | {k: v * V.MAX_STARS for k, v in axes.items()}


def contained_profiles(titles: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pairs whose profile tokens are all among the title's tokens: score 100 + 10 for each token.

    ``titles`` has title_id and title, ``profiles`` profile and name. An inverted index instead of a
    cross join: tokens join by equality, and the matched tokens of a pair are counted.
    """
    left = titles.select("title_id", F.explode(F.array_distinct(X.title_tokens(F.col("title")))).alias("token"))
    right = profiles.select("profile", F.array_distinct(X.title_tokens(F.col("name"))).alias("tokens")).select("profile", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    hits = left.join(right, "token").groupBy("title_id", "profile", "n").agg(F.count("*").alias("hits"))
    return hits.where("hits = n").select("title_id", "profile", (F.lit(100) + 10 * F.col("n")).cast("bigint").alias("score"))


def profile_votes(skills: DataFrame, profiles: DataFrame, least: int = 2, top: int = 5) -> DataFrame:
    """The best ``top`` profiles of each owner by its skills.

    ``skills`` has owner and skill, ``profiles`` profile, skill and rank (from 0). A shared skill adds
    10 and up to 5 for a high rank; profiles with fewer than ``least`` shared skills do not count.
    """
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    have = skills.select("owner", key("skill").alias("k")).distinct()
    want = profiles.select("profile", key("skill").alias("k"), (F.lit(10) + F.greatest(F.lit(0), F.lit(5) - F.col("rank"))).alias("points"))
    votes = have.join(want, "k").groupBy("owner", "profile").agg(F.sum("points").cast("bigint").alias("score"), F.count("*").alias("shared")).where(F.col("shared") >= least)
    nth = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("score"), "profile"))
    return votes.withColumn("place", nth).where(F.col("place") <= top)


def noun_phrases(df: DataFrame, key: str, text: str) -> DataFrame:
    """Capitalised phrases of two to four words and acronyms, with their counts in each text."""
    # a capital is looked for first, then what is before it
    phrase = "([A-Z](?<![A-Za-z0-9_&-][A-Z])[A-Za-z][A-Za-z&-]*(?:[ \\t]+[A-Z][A-Za-z][A-Za-z&-]*){1,3})"
    acronym = "([A-Z](?<![A-Za-z0-9_][A-Z])[A-Z0-9]{1,5})"
    found = F.concat(F.regexp_extract_all(text, F.lit(phrase), 1), F.regexp_extract_all(text, F.lit(acronym), 1))
    # bound before it is exploded, as Spark also tests whether it is empty
    once = df.select(key, F.explode(F.array(found)).alias("found"))
    return once.select(key, F.explode("found").alias("phrase")).groupBy(key, F.lower("phrase").alias("phrase")).agg(F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """Each row of ``left`` with ``value`` of the latest row of ``right`` of its key at or before its time.

    One sort of both sides together, no range join: rows of ``right`` come first among equal times, and
    the last value so far is carried to the rows of ``left``.
    """
    both = left.withColumns({"__v": F.lit(None).cast(right.schema[value].dataType), "__side": F.lit(1)}).unionByName(
        right.select(key, at, F.col(value).alias("__v"), F.col(tie)).withColumn("__side", F.lit(0)), allowMissingColumns=True
    )
    upto = Window.partitionBy(key).orderBy(at, "__side", tie).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(upto)).where("__side = 1").select(*left.columns, value)
