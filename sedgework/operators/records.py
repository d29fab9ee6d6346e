"""Records and their doubles: keys, pairs within a time span, clusters, merges, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions import text as X
from sedgework.functions import values as V


def record_key(company: Column, title: Column) -> Column:
    """Company and title in one form; null if one is empty."""
    c, t = X.flat_company(company), X.flat(title)
    return F.when((c != "") & (t != ""), F.concat_ws("\t", c, t))


def first_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Of the rows of a key the one of the smallest ``order`` (unique); a partial aggregate, no window."""
    whole = F.struct(*df.columns)
    return df.groupBy(key.alias("__key")).agg(F.min_by(whole, F.col(order)).alias("r")).select("r.*")


def union_first_wins(first: DataFrame, second: DataFrame, key: Column, order: str) -> DataFrame:
    """Both sets without doubles; rows of ``first`` win."""
    both = first.withColumn("__set", F.lit(0)).unionByName(second.withColumn("__set", F.lit(1)))
    whole = F.struct(*first.columns)
    return both.groupBy(key.alias("__key")).agg(F.min_by(whole, F.struct("__set", order)).alias("r")).select("r.*")


def pairs_within_days(df: DataFrame, block: list[str], id_: str, at: str, days: int = V.REPOST_SPAN_DAYS) -> DataFrame:
    """Pairs (a < b) of a block whose times differ by at most ``days``; a null time pairs with nothing.

    A range join on time cells as wide as the span: a row goes to its own cell and is met there and
    from the cell before, so a block costs rows times their neighbours in time, not its square.
    """
    width = F.lit(days * 86400)
    rows = df.where(F.col(at).isNotNull()).select(*block, F.col(id_).alias("id"), F.unix_timestamp(at).alias("s")).withColumn("cell", F.floor(F.col("s") / width))
    left = rows.select(*block, F.col("id").alias("l"), F.col("s").alias("ls"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    right = rows.select(*block, F.col("id").alias("r"), F.col("s").alias("rs"), "cell")
    near = left.join(right, [*block, "cell"]).where((F.col("l") < F.col("r")) & (F.abs(F.col("ls") - F.col("rs")) <= width))
    return near.select(*block, F.col("l").alias("a"), F.col("r").alias("b"), (F.abs(F.col("ls") - F.col("rs")) / 86400).alias("days"))


def repost_clusters(df: DataFrame, block: list[str], at: str, days: int = V.REPOST_SPAN_DAYS) -> DataFrame:
    """Blocks of two rows or more whose times span more than ``days`` in all, or have an unusable time.

    first_seen, last_seen and span_days are null where a member has no usable time.
    """
    g = df.groupBy(*block).agg(F.count("*").alias("members"), F.count(at).alias("usable"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    span = (F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen")) / 86400
    whole = F.col("usable") == F.col("members")
    g = g.withColumn("span", span).where((F.col("members") >= 2) & (~whole | (F.col("span") > days)))
    return g.select(*block, "members", *[F.when(whole, F.col(c)).alias(c) for c in ("first_seen", "last_seen")], F.when(whole, X.floor_half(F.col("span")).cast("bigint")).alias("span_days"))


def confidence_of_pairs(pairs: DataFrame) -> DataFrame:
    """Grade candidate pairs: certain, probable, title-only or possible; other pairs go.

    ``pairs`` has, with the prefixes ``a_`` and ``b_``: url (canonical), company, title, body, posted,
    place, pay and at (timestamp). An equal URL is certain. Otherwise the companies must be equal;
    then an equal title is probable if something corroborates it (an equal body or date, equal place
    and pay, times within the span) and title-only if not; similar titles with overlapping bodies are
    possible.
    """
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    same = lambda c, f: (f(a(c)) != "") & (f(a(c)) == f(b(c)))
    gap = F.abs(F.unix_timestamp(a("at")) - F.unix_timestamp(b("at"))) <= V.REPOST_SPAN_DAYS * 86400
    backed = same("body", X.flat) | same("posted", X.flat) | (same("place", X.flat) & same("pay", X.flat)) | F.coalesce(gap, F.lit(False))
    similar = (X.containment(X.token_set(a("title")), X.token_set(b("title"))) >= V.SIMILAR_TITLE) & (
        X.containment(X.token_set(a("body"), V.TEXT_TOKEN_MIN), X.token_set(b("body"), V.TEXT_TOKEN_MIN)) >= V.OVERLAPPING_TEXT
    )
    grade = (
        F.when(F.coalesce(a("url") == b("url"), F.lit(False)), "certain")
        .when(~same("company", X.flat_company), None)
        .when(same("title", X.flat), F.when(backed, "probable").otherwise("title-only"))
        .when(similar, "possible")
    )
    return pairs.withColumn("confidence", grade).where("confidence is not null")


def candidate_pairs(df: DataFrame) -> DataFrame:
    """Graded pairs of records (id, url, company, title, body, posted, place, pay, at), one for each pair.

    Candidates meet by canonical URL or by company; a pair that meets twice counts once.
    """
    cols = ["id", "url", "company", "title", "body", "posted", "place", "pay", "at"]
    company = X.flat_company(F.col("company"))
    keys = F.array_compact(F.array(F.concat(F.lit("u:"), "url"), F.when(company != "", F.concat(F.lit("c:"), company))))
    rows = df.select(*cols, F.explode(keys).alias("block"))
    side = lambda p: rows.select("block", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    met = side("a").join(side("b"), "block").where("a_id < b_id").drop("block").dropDuplicates(["a_id", "b_id"])
    return confidence_of_pairs(met).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "confidence")


def fill_missing(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row for each key: of each column the first value that is neither null nor blank, by ``order``."""
    def first(c: str) -> Column:
        v = F.col(c)
        there = v.isNotNull() & (F.trim(v.cast("string")) != "")
        return F.min_by(v, F.when(there, F.col(order)))

    return df.groupBy(*key).agg(F.min(order).alias(order), F.count("*").alias("merged"), *[first(c).alias(c) for c in columns])


def joined_notes(kept: Column, added: Column) -> Column:
    """Both notes, a blank line between; one of them where the other is blank or the same."""
    k, a = F.trim(F.coalesce(kept, F.lit(""))), F.trim(F.coalesce(added, F.lit("")))
    return F.when((a == "") | (k == a), kept).when(k == "", added).otherwise(F.concat(kept, F.lit("\n\n"), added))


def except_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one set alone, with ``side`` ('missing' from b, 'extra' in b)."""
    return a.exceptAll(b).distinct().withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).distinct().withColumn("side", F.lit("extra")))


def cap_per_group(df: DataFrame, group: Column, order: str, most: int = V.COMPANY_CAP) -> DataFrame:
    """The first ``most`` rows of each group. The limit is pushed below the shuffle (a group limit in each task)."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("nth", nth).where(F.col("nth") <= most)


def exclude_unless_empty(df: DataFrame, column: Column, terms: list[str]) -> DataFrame:
    """Drop rows whose column contains a term; if none would be left, keep all and mark them ``suppressed``.

    The decision is one global flag: a single-row aggregate, joined back by a broadcast of one row.
    """
    hit = reduce(lambda a, b: a | b, (F.lower(column).contains(t) for t in terms), F.lit(False))
    rows = df.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    flag = rows.agg((F.count(F.when(~F.col("__hit"), 1)) == 0).alias("suppressed"))
    return rows.join(F.broadcast(flag), how="cross").where(~F.col("__hit") | F.col("suppressed")).drop("__hit")
