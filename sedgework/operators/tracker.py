"""Tracked records that are one: pairs by their addresses, also former ones, and the merge of two as one operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.functions import urls as U
from sedgework.functions import values as V
from sedgework.functions.dates import let
from sedgework.operators.records import joined_notes

NO_URLS = "array<string>"


def addresses(url: Column, aliases: Column) -> Column:
    """The canonical forms of a record's address and of its former ones, each once."""
    all_ = F.concat(F.array(url), F.coalesce(aliases, F.array().cast(NO_URLS)))
    return F.array_distinct(F.filter(F.transform(all_, U.canonical), lambda u: u.isNotNull()))


def by_address(jobs: DataFrame) -> DataFrame:
    """(address, id): the record of each canonical address; of several the smallest id."""
    each = jobs.select("id", F.explode(addresses(F.col("url"), F.col("alias_urls"))).alias("address"))
    return each.groupBy("address").agg(F.min("id").alias("id"))


def same_address(jobs: DataFrame) -> DataFrame:
    """(id, first_id) of the records that share an address, present or former, with a record of a smaller id: the smallest of these.

    One row a record, however many share an address.
    """
    each = jobs.select("id", F.explode(addresses(F.col("url"), F.col("alias_urls"))).alias("address"))
    found = each.join(by_address(jobs).withColumnRenamed("id", "first_id"), "address").where(F.col("first_id") < F.col("id"))
    return found.groupBy("id").agg(F.min("first_id").alias("first_id"))


def missing(value: Column, kind: str) -> Column:
    return value.isNull() | (value == "") if kind == "string" else value.isNull() | (F.size(value) == 0) if kind.startswith("array") else value.isNull()


def merged(jobs: DataFrame, letters: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and letters after merging ``pairs`` (survivor, absorbed).

    A survivor's empty fields are filled from the absorbed record (not its times, notes, capture and origin), notes are put together, the
    absorbed record's addresses become former ones of the survivor; the absorbed record goes and its letters follow. Pairs of a record with itself,
    of records that aren't there, and further pairs of a record that is in one already (by the smallest survivor, then absorbed) are left alone.
    """
    # sorted and not broadcast: a compressed column of ids looks small, its hash table is not
    ids = jobs.select("id").hint("merge")
    real = pairs.where("survivor <> absorbed").join(ids.withColumnRenamed("id", "survivor"), "survivor").join(ids.withColumnRenamed("id", "absorbed"), "absorbed").distinct()
    # a record is in one pair: both sides take their first pair, and a pair holds if both took it
    pair = F.struct("survivor", "absorbed")
    sides = real.select(F.explode(F.array("survivor", "absorbed")).alias("id"), pair.alias("p")).groupBy("id").agg(F.min("p").alias("p"))
    kept = sides.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.*")
    # only pairs are put side by side; records in none go past these joins as they are
    alone = jobs.join(kept.select(F.explode(F.array("survivor", "absorbed")).alias("id")), "id", "left_anti").select(*jobs.columns)
    both = kept.join(jobs.alias("s"), F.col("s.id") == F.col("survivor")).join(jobs.alias("a"), F.col("a.id") == F.col("absorbed"))
    kinds = dict(jobs.dtypes)
    s, a = (lambda c: F.col(f"s.`{c}`")), (lambda c: F.col(f"a.`{c}`"))
    fill = lambda c: s(c) if c in V.NOT_FILLED else F.when(missing(s(c), kinds[c]) & ~missing(a(c), kinds[c]), a(c)).otherwise(s(c))
    out = {c: fill(c) for c in jobs.columns}
    if "notes" in kinds:
        out["notes"] = joined_notes(s("notes"), a("notes"))
    if "alias_urls" in kinds:
        none = F.array().cast(NO_URLS)
        former = F.concat(F.coalesce(s("alias_urls"), none), F.array(a("url")), F.coalesce(a("alias_urls"), none))
        others = lambda own: F.array_distinct(F.filter(F.transform(former, U.canonical), lambda u: u.isNotNull() & ~F.coalesce(u == own, F.lit(False))))
        out["alias_urls"] = let(U.canonical(out["url"]), lambda own: let(others(own), lambda known: F.when(F.size(known) > 0, known)))
    records = both.select(*[c.alias(n) for n, c in out.items()]).unionByName(alone)
    moved = letters.join(kept.select(F.col("absorbed").alias("job_id"), "survivor"), "job_id", "left")
    return records, moved.withColumn("job_id", F.coalesce("survivor", "job_id")).select(*letters.columns)


def accepted_lines(text: Column, changes: Column) -> Column:
    """A text's lines after accepted changes (original, rewritten): a line takes its rewriting, and goes where that is null; equal lines take their changes in order.

    Changes without an original are added at the end.
    """
    start = F.coalesce(F.split(text, "\n"), F.array().cast("array<string>"))
    mark = F.lit("\u0000")

    def step(lines: Column, c: Column) -> Column:
        at = F.array_position(lines, c["original"])
        put = F.transform(lines, lambda x, i: F.when(i + 1 == at, F.concat(mark, F.coalesce(c["rewritten"], mark))).otherwise(x))
        return F.when(c["original"].isNull(), F.when(c["rewritten"].isNotNull(), F.concat(lines, F.array(F.concat(mark, c["rewritten"])))).otherwise(lines)).when(at > 0, put).otherwise(lines)

    done = F.aggregate(changes, start, step)
    left = F.filter(done, lambda x: x != F.concat(mark, mark))
    return F.array_join(F.transform(left, lambda x: F.regexp_replace(x, "^\u0000", "")), "\n")
