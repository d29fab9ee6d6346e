"""Measures of parses of records: confidence, gates, scores in words, families, skills, and scores against a truth.

A parse is a row; its entries, skills and pages are rows of other tables, and are aggregated by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.functions import values as V
from sedgework.operators import search


def is_scanned(pages: DataFrame, key: str, chars: str) -> DataFrame:
    """(key, scanned): whether a document's pages hold fewer than 80 characters on average."""
    return pages.groupBy(key).agg((F.avg(chars) < V.SCANNED_CHARS).alias("scanned"))


def weighted_confidence(conf: dict[str, Column]) -> Column:
    """Mean of the confidences that are above 0, by the weights of their fields; 0 without any."""
    some = {f: F.coalesce(c, F.lit(0.0)) for f, c in conf.items()}
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    weight = add([F.when(c > 0, V.FIELD_WEIGHTS[f]).otherwise(0.0) for f, c in some.items()])
    return F.when(weight > 0, add([F.when(c > 0, c * V.FIELD_WEIGHTS[f]).otherwise(0.0) for f, c in some.items()]) / weight).otherwise(0.0)


def hard_failures(email: Column, email_conf: Column, entries: Column, student: Column, raw_chars: Column, found_chars: Column, name_conf: Column) -> Column:
    """The gates that a parse fails, in order."""
    low = lambda c, floor: F.coalesce(c, F.lit(0.0)) < floor
    return F.array_compact(F.array(
        F.when((F.coalesce(email, F.lit("")) == "") | low(email_conf, 0.5), "no_email"),
        F.when((entries == 0) & ~student, "zero_experience_non_student"),
        F.when((raw_chars > 0) & (found_chars / raw_chars < V.EXTRACTION_FLOOR), "low_extraction_ratio"),
        F.when(low(name_conf, V.NAME_FLOOR), "low_name_confidence"),
    ))


def confidence(conf: dict[str, Column], failures: Column, scanned: Column, two_columns: Column, flags: dict[str, Column]) -> tuple[Column, Column]:
    """Confidence (0 to 1) of a parse, and the further pass it needs. ``flags`` are the soft failures by name."""
    base = weighted_confidence(conf)
    base = F.when(two_columns, F.least(base, F.lit(V.TWO_COLUMN_CAP))).otherwise(base)
    penalty = reduce(lambda a, b: a + b, [F.when(c, V.SOFT_PENALTIES[n]).otherwise(0.0) for n, c in flags.items()])
    value = F.when(scanned | (F.size(failures) > 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - penalty)))
    return value, search.escalation(scanned, two_columns, F.size(failures), value)


def overall_score(specificity: Column, structure: Column, completeness: Column) -> Column:
    w = V.SCORE_WEIGHTS
    return F.floor(specificity * w["specificity"] + structure * w["structure"] + completeness * w["completeness"] + 0.5).cast("bigint")


def weakest(ratios: dict[str, Column]) -> Column:
    """The name of the smallest ratio, the first among ties; nulls (not gradable) don't count."""
    least = F.array_min(F.array(*ratios.values()))
    return F.coalesce(*[F.when(r == least, F.lit(name)) for name, r in ratios.items()])


def recommendation(tier: Column, weak: Column, missing: Column, scanned: Column) -> Column:
    """What to do next, in one sentence. ``missing`` names what a complete record lacks."""
    first = F.array_join(F.slice(missing, 1, 2), " and ")
    step = (
        F.when(weak.isNull(), V.NOTHING_TO_GRADE).when(weak != "completeness", F.coalesce(*[F.when(weak == k, F.lit(v)) for k, v in V.NEXT_STEPS.items()]))
        .when(F.size(missing) == 0, V.ROUND_OUT).otherwise(F.concat(F.lit("check that "), first, F.when(F.size(missing) == 1, " extracts").otherwise(" extract"), F.lit(" as plain text")))
    )
    opener = F.coalesce(*[F.when(tier == k, F.lit(v)) for k, v in V.BAND_OPENERS.items()])
    return F.when(scanned, V.SCANNED_ADVICE).otherwise(F.concat(opener, F.lit(" — "), step, F.lit(".")))


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def role_families(titles: DataFrame, key: str, title: str, families: dict[str, list[str]]) -> DataFrame:
    """(key, families, keywords): the family that most titles speak for, and runners-up of half its titles or more, two in all.

    ``families`` holds each family's words (parts of titles, in lower case), in order of preference.
    """
    low = F.lower(title)
    hits = [F.count(F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), 1)).alias(f"__{i}") for i, words in enumerate(families.values())]
    counted = titles.groupBy(key).agg(*hits)
    scored = F.array(*[F.struct((-F.col(f"__{i}")).alias("less"), F.lit(i).alias("i"), F.lit(name).alias("family"), F.array(*map(F.lit, words)).alias("words")) for i, (name, words) in enumerate(families.items())])
    ranked = F.sort_array(F.filter(scored, lambda s: s["less"] < 0))
    top = F.slice(F.filter("__r", lambda s: s["less"] * V.RUNNER_UP_SHARE <= F.col("__r")[0]["less"]), 1, V.MAX_FAMILIES)
    rows = counted.select(key, F.explode(F.array(ranked)).alias("__r")).withColumn("__r", F.when(F.size("__r") > 0, top).otherwise(F.col("__r")))
    return rows.select(key, F.array_join(F.transform("__r", lambda s: s["family"]), ",").alias("families"), F.array_join(F.array_distinct(F.flatten(F.transform("__r", lambda s: s["words"]))), ",").alias("keywords"))


def skills_order(df: DataFrame, skills: str, title: str) -> DataFrame:
    """buried and suggested (arrays) of each row: the most relevant skills behind the front of the list, and the list by relevance.

    Both are null where there are fewer than five skills, none is relevant, or none is buried.
    """
    scored = F.transform(F.col(skills), lambda s, i: F.struct((-search.relevance(s, F.col(title))).alias("less"), i.alias("i"), s.alias("skill")))
    rows = df.withColumn("__s", F.explode(F.array(F.sort_array(scored))))
    front = F.greatest(F.lit(V.LEAST_FRONT), F.ceil(F.size(skills) * V.FRONT_SHARE))
    best = F.col("__s")[0]["less"]
    buried = F.transform(F.filter("__s", lambda s: (s["i"] >= front) & (s["less"] == best)), lambda s: s["skill"])
    found = (F.size(skills) >= V.LEAST_SKILLS) & (best < 0) & (F.size(buried) > 0)
    return rows.withColumns({"buried": F.when(found, buried), "suggested": F.when(found, F.transform("__s", lambda s: s["skill"]))}).drop("__s")


def edited_skills(base: Column, removed: Column, added: Column) -> Column:
    """A list without removed members and with added ones that it lacks, whatever their case."""
    lower = lambda a: F.transform(a, F.lower)
    kept = F.filter(base, lambda s: ~F.array_contains(lower(removed), F.lower(s)))
    new = F.filter(added, lambda s, i: ~F.array_contains(lower(kept), F.lower(s)) & (F.array_position(lower(added), F.lower(s)) == i + 1))
    return F.concat(kept, new)


def suggested_skills(pool: Column, existing: Column, query: Column) -> Column:
    """Six members of a pool that aren't there yet: those that begin with the query, then those that contain it."""
    q = F.lower(F.trim(query))
    have = F.transform(existing, F.lower)
    open_ = F.filter(pool, lambda c: ~F.array_contains(have, F.lower(c)))
    begins = F.filter(open_, lambda c: F.lower(c).startswith(q))
    holds = F.filter(open_, lambda c: F.lower(c).contains(q) & ~F.lower(c).startswith(q))
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.slice(F.concat(begins, holds), 1, V.SUGGESTIONS))


def plain(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(x)), "\\s+", " ")


def scalar_scores(df: DataFrame, fields: list[str]) -> DataFrame:
    """Status of each field (``<f>`` against ``<f>_true``: match, mismatch, missing, skipped) and the accuracy over those with a truth."""
    def status(f: str) -> Column:
        got, true = F.col(f), F.col(f"{f}_true")
        return F.when(true.isNull(), "skipped").when(got.isNull(), "missing").when(plain(got) == plain(true), "match").otherwise("mismatch")

    out = df.withColumns({f"{f}_status": status(f) for f in fields})
    judged = reduce(lambda a, b: a + b, [F.when(F.col(f"{f}_status") != "skipped", 1).otherwise(0) for f in fields])
    right = reduce(lambda a, b: a + b, [F.when(F.col(f"{f}_status") == "match", 1).otherwise(0) for f in fields])
    return out.withColumn("accuracy", F.when(judged > 0, right / judged).otherwise(1.0))


def set_scores(got: Column, true: Column) -> tuple[Column, Column]:
    """Jaccard of two lists as sets (two empty ones: 1), and the recall of the true members, each counted (none: 1)."""
    a, b = F.array_distinct(F.transform(got, plain)), F.transform(true, plain)
    union = F.size(F.array_union(a, b))
    jaccard = F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)
    return jaccard, F.when(F.size(b) > 0, F.size(F.filter(b, lambda x: F.array_contains(a, x))) / F.size(b)).otherwise(1.0)


def set_scores_of(members: DataFrame, keys: list[str], member: str, got: Column, true: Column) -> DataFrame:
    """(keys, jaccard, recall) as ``set_scores``, of lists whose members are rows: ``got`` and ``true`` say on which lists a row's member stands.

    Members are counted before a key's are put together, so that the cost is one row a different member, however long the lists are.
    A null member is of no set, but counts among the true ones.
    """
    n = lambda c: F.count(F.when(c, 1))
    each = members.withColumn("__m", plain(F.col(member))).groupBy(*keys, "__m").agg(n(got & F.col("__m").isNotNull()).alias("g"), n(true).alias("t"))
    sums = each.groupBy(*keys).agg(n((F.col("g") > 0) & (F.col("t") > 0)).alias("both"), n(((F.col("g") > 0) | (F.col("t") > 0)) & F.col("__m").isNotNull()).alias("any"), F.sum(F.when(F.col("g") > 0, F.col("t"))).alias("found"), F.sum("t").alias("all"))
    share = lambda a, b: F.when(F.col(b) > 0, F.coalesce(a, F.lit(0)) / F.col(b)).otherwise(1.0)
    return sums.select(*keys, share("both", "any").alias("jaccard"), share("found", "all").alias("recall"))


def verdict_counts(requirements: DataFrame, verdicts: DataFrame, key: str, item: str) -> DataFrame:
    """(key, met, partial, missing, total) of requirements (key, item) by their verdicts (key, item, status); without one: missing."""
    both = requirements.join(verdicts.select(key, item, "status"), [key, item], "left")
    n = lambda c: F.count(F.when(c, 1))
    known = F.coalesce("status", F.lit("missing"))
    return both.groupBy(key).agg(n(known == "met").alias("met"), n(known == "partial").alias("partial"), n(~known.isin("met", "partial")).alias("missing"), F.count("*").alias("total"))


def overlaid(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row with the other's value where that isn't blank."""
    new = over.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    value = lambda c: F.when(F.trim(F.coalesce(F.col(f"__{c}").cast("string"), F.lit(""))) != "", F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return base.join(new, key, "left").select(key, *map(value, columns))


def diverged(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The names of the axes on which two rows differ."""
    return F.array_compact(F.array(*[F.when(~a[k].eqNullSafe(b[k]), F.lit(k)) for k in a]))


def curated_counts(curated: DataFrame, mined: DataFrame) -> DataFrame:
    """(term, key, n): mined counts (form, n) of each curated term (term), by their plain key; forms of one key are added up."""
    keyed = mined.groupBy(plain(F.col("form")).alias("key")).agg(F.sum("n").alias("n"))
    return curated.select("term", plain(F.col("term")).alias("key")).join(keyed, "key", "left").select("term", "key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def sidebar_sides(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side) of pages with a column boundary ``split``: the clearly narrower side of it by the lines' ``x0`` and ``x1``; null if none."""
    box = lines.groupBy(*keys).agg((F.first("split") - F.min("x0")).alias("left"), (F.max("x1") - F.first("split")).alias("right"))
    real = (F.col("left") > 0) & (F.col("right") > 0)
    side = F.when(real & (F.col("left") <= F.col("right") * V.SIDEBAR_RATIO), "left").when(real & (F.col("right") <= F.col("left") * V.SIDEBAR_RATIO), "right")
    return box.select(*keys, side.alias("side"))
