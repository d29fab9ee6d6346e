"""Mix sources to target weights, without a global shuffle of texts.

Documents are cut into blocks of words. Each source's blocks are permuted (by hash, anew for each pass over the
source), and the first of them, up to the source's target, are its quota: so many ranks of its permutation.
A splitting tree deals the quotas to the output's shards: the shards of a node are halved, and a
multivariate hypergeometric draw says how many blocks of each source go to the left half, as if all blocks
of all sources had been shuffled together. So each shard gets an interval of each source's ranks, shards are
disjoint, every quota is dealt exactly, and a block finds its shard by an equi-join on its rank. Within a shard
the blocks are then shuffled by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgework.llm.common import table, written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    """Words of a block, blocks of a shard (about), passes over a source at most, weights of the sources in turn."""

    block_words: int = 512
    shard_blocks: int = 2_048
    most: int = 3
    weights: tuple[int, ...] = (1, 2, 3)
    seed: int = 42
    #: shards of one task of the splitting tree
    chunk: int = 256


def sized(docs: DataFrame) -> DataFrame:
    """A row for each different document: doc_id, source, size (words), key (its hash), and how often it is there."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "source", "text").alias("key"))
    return rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies"))


def targets(rows: DataFrame, want: Settings) -> DataFrame:
    """A row for each source: its number by code point (null last), size, target and what is to be taken.

    All words are shared by weight; a target stops at ``most`` times its source's size and the excess is shared
    again until none is above. This is a water level: with the sources in the order of limit by weight, those
    are at their limit for which the level without them is above it. One row a source goes through the windows.
    """
    pieces = F.ceil(F.col("size") / want.block_words)
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum(pieces * F.col("copies")).alias("blocks"))
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weights = F.array(*map(F.lit, want.weights))
    sources = sources.withColumn("nth", nth).withColumn("weight", F.element_at(weights, (F.col("nth") - 1) % len(want.weights) + 1)).withColumn("limit", want.most * F.col("source_size"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    left = lambda c, total: F.sum(total).over(every) - F.coalesce(F.sum(c).over(before), F.lit(0))
    level = left("limit", "source_size") / left("weight", "weight")
    sources = sources.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") > F.col("limit"))
    share = F.max(F.when(~F.col("full"), F.col("level"))).over(every) * F.col("weight")
    sources = sources.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.least(share, F.col("limit"))).cast("double"))
    goal = F.least(F.floor(F.col("target") + 0.5).cast("bigint"), F.col("limit"))
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("bigint")
    return sources.select("source", "source_size", "target", "nth", "blocks", passes.alias("passes"), (goal - passes * F.col("source_size")).alias("rest"))


def drawn(rows: DataFrame, sources: DataFrame, want: Settings) -> DataFrame:
    """The blocks that the mix takes, with their rank in their source's order: whole passes first, then a part of one.

    A rank is the number of blocks in smaller cells of the hash plus the rank in the block's cell, so that no source is
    sorted in one task. The last block is cut so that the source's taken words are its target.
    """
    own = sources.withColumnRenamed("source", "of")
    start = F.col("piece").cast("bigint") * want.block_words
    blocks = (
        rows.join(own, F.col("source").eqNullSafe(F.col("of"))).where("size > 0 AND (passes > 0 OR rest > 0)")
        .select("doc_id", "key", "copies", "size", "nth", "blocks", "passes", "rest", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / want.block_words) - 1).cast("int"))).alias("piece"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.when(F.col("rest") > 0, F.col("passes")).otherwise(F.col("passes") - 1).cast("int"))))
        .withColumn("start", start).withColumn("words", F.least(F.lit(want.block_words).cast("bigint"), F.col("size") - F.col("start")))
        .withColumn("hash", F.xxhash64(F.lit(want.seed), "key", "copy", "piece", "pass")).withColumn("cell", F.shiftrightunsigned("hash", 52).cast("int"))
    )
    cell = ["nth", "pass", "cell"]
    below = Window.partitionBy("nth", "pass").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = blocks.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    cells = cells.select(*cell, F.coalesce(F.sum("n").over(below), F.lit(0)).alias("blocks_below"), F.coalesce(F.sum("w").over(below), F.lit(0)).alias("words_below"))
    inside = Window.partitionBy(*cell).orderBy("hash", "key", "copy", "piece")
    words_before = F.col("words_below") + F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = blocks.join(cells, cell).select("*", (F.col("blocks_below") + F.row_number().over(inside) - 1 + F.col("pass") * F.col("blocks")).alias("rank"), words_before.alias("words_before"))
    left = F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.col("rest") - F.col("words_before"))
    return ranked.where(left > 0).select("doc_id", "key", "copy", "nth", "piece", "pass", "start", F.least("words", left).alias("words"), "rank", "hash")


def hypergeometric(u: float, good: int, bad: int, sample: int) -> int:
    """The hypergeometric number whose cumulated probability first exceeds ``u``, for numbers of any size.

    Probabilities are built by ratios over twelve standard deviations around the mean (all else is below 1e-30).
    """
    low, high = max(0, sample - bad), min(good, sample)
    total = good + bad
    if low == high:
        return low
    mean = sample * (good / total)
    width = 12 * (mean * (bad / total) * ((total - sample) / max(1, total - 1))) ** 0.5 + 30
    x = np.arange(max(low, int(mean - width)), min(high, int(mean + width) + 1) + 1, dtype=np.float64)
    steps = np.log((good - x[:-1]) * (sample - x[:-1])) - np.log((x[:-1] + 1) * (bad - sample + x[:-1] + 1))
    mass = np.concatenate(([0.0], np.cumsum(steps)))
    mass = np.cumsum(np.exp(mass - mass.max()))
    return int(x[min(len(x) - 1, np.searchsorted(mass, u * mass[-1], "right"))])


def dealt(counts: np.ndarray, total: int, shards: int, low: int, high: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shards ``low`` to ``high`` with the first rank and the number of ranks that they get of each source.

    Every node draws from a generator of its own, so that each part of the tree can be built alone.
    """
    edge = lambda s: total * s // shards
    todo = [(0, shards, np.zeros(len(counts), np.int64), counts)]
    while todo:
        a, b, first, here = todo.pop()
        if b <= low or a >= high:
            continue
        if b - a == 1:
            yield a, first, here
            continue
        middle = (a + b) // 2
        chances = np.random.Generator(np.random.PCG64([seed, a, b])).random(len(here))
        want, rest, left = edge(middle) - edge(a), int(here.sum()), np.zeros(len(here), np.int64)
        for k, (u, n) in enumerate(zip(chances.tolist(), here.tolist(), strict=True)):
            left[k] = x = hypergeometric(u, n, rest - n, want)
            rest, want = rest - n, want - x
        todo += [(middle, b, first + left, here - left), (a, middle, first, left)]


def split(quotas: DataFrame, total: int, want: Settings) -> DataFrame:
    """Each shard's interval of each source's ranks (nth, shard, first, n) from the quotas (nth, quota).

    A task has the numbers of all sources (one row a source) and builds the part of the tree above its shards.
    """
    shards = max(1, -(-total // want.shard_blocks))
    chunks = quotas.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // want.chunk))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        low = int(rows["chunk"].iloc[0]) * want.chunk
        parts = dealt(rows["quota"].to_numpy(np.int64), total, shards, low, min(shards, low + want.chunk), want.seed)
        found = [pd.DataFrame({"nth": rows["nth"].to_numpy(), "shard": s, "first": first, "n": n}) for s, first, n in parts]
        return pd.concat(found).query("n > 0")

    return chunks.groupBy("chunk").applyInPandas(run, "nth int, shard int, first long, n long")


def plan(rows: DataFrame, sources: DataFrame, want: Settings | None = None) -> DataFrame:
    """The mix: shard, position there, the block (doc_id, key, copy, piece, start and number of its words) and its pass."""
    want = want or Settings()
    blocks = written(drawn(rows, sources, want))
    total = blocks.count()
    parts = split(blocks.groupBy("nth").agg(F.count("*").alias("quota")), total, want)
    ranks = parts.select("nth", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("rank"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(want.seed + 1), "hash"), "hash", "rank")) - 1
    found = blocks.join(ranks.hint("merge"), ["nth", "rank"])  # ranks are as many as blocks, though the plan takes them for few
    return found.select("shard", place.alias("position"), "doc_id", "key", "copy", "piece", "pass", "start", "words")


def texts(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The blocks of a plan with their words: shard, position, doc_id, text (words joined by blanks)."""
    whole = docs.select(F.xxhash64("doc_id", "source", "text").alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("start") + 1).cast("int"), F.col("words").cast("int"))
    return mix.join(whole, "key").select("shard", "position", "doc_id", F.array_join(words, " ").alias("text"))


def mixed(docs: DataFrame, want: Settings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The different documents, the sources with their targets, and the plan of the mix.

    ``docs`` has doc_id, source and text; further columns are not read. A null text has no word and is never
    taken; null ids and sources are values as others (the null source comes last). Repeated rows are
    documents of their own, told apart by a number. Ties in a permutation are broken by key, copy and piece. An
    empty table gives empty results. Very long texts are many blocks. Equal inputs give equal mixes.
    """
    want = want or Settings()
    rows = written(sized(docs))
    sources = written(targets(rows, want))
    return rows, sources, plan(rows, sources, want)


def op13_source_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with its words, its source's words and target, and the words that the mix takes of it."""
    rows, sources, mix = mixed(table(spark, sf_dir, "documents"))
    taken = mix.groupBy(F.col("key").alias("k"), F.col("doc_id").alias("d"), F.col("copy").alias("c")).agg(F.sum("words").alias("taken"))
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    each = each.join(taken, (F.col("key") == F.col("k")) & (F.col("copy") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return each.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "source")
