"""Approximate nearest neighbours by one forest of hash prefixes over the whole table.

Each tree gives a vector a long string of hash symbols; a symbol is the place and sign of the largest
of some random orthogonal projections. Each tree's strings, in sorted order, are cut into cells by
splitters. A query descends each tree to the longest prefix it shares with some string; then all
trees ascend together, one bit at a time, until their prefix ranges hold the wanted number of
candidates. The query goes to the cells that its ranges meet, is scored exactly there, in double
precision, against the rows inside of its range, and the best of all cells are merged.

Rows are moved once a tree, queries once for each cell they meet. The splitters and the numbers of
rows below a prefix come from a bounded sample of the vectors (``Settings.sample_rows``); every
vector is indexed. Equal vectors are searched as one, so a vector that a third of all rows have is one
row of the forest; cells of many like vectors, or met by many queries, are split by a salt.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.llm.common import table, tidied, written


@dataclass(frozen=True)
class Settings:
    """A query's candidates, counted once in each tree that finds them, are ``reach * rows ** growth`` at least.

    Vectors without any structure need a share of all rows that shrinks slowly; others need less.
    """

    trees: int = 16
    symbols: int = 12
    projections: int = 16
    reach: float = 11.0
    growth: float = 0.7
    cell_rows: int = 4096
    cell_queries: int = 8192
    sample_rows: int = 32_768
    neighbours: int = 20

    @property
    def symbol_bits(self) -> int:
        return (2 * self.projections - 1).bit_length()

    @property
    def bits(self) -> int:
        return self.symbols * self.symbol_bits


@lru_cache(2)
def planes(dims: int, settings: Settings) -> np.ndarray:
    """Projections as columns, those of a symbol side by side; of one orthogonal basis where it is wide enough."""
    rng, m = np.random.default_rng(64), settings.projections
    out: list[np.ndarray] = []
    pool = np.zeros((dims, 0))
    for _ in range(settings.trees * settings.symbols):
        if pool.shape[1] < m:
            pool = np.linalg.qr(rng.normal(size=(dims, dims)))[0] if dims >= m else rng.normal(size=(dims, m))
        out.append(pool[:, :m])
        pool = pool[:, m:]
    return np.concatenate(out, 1)


def strings(x: np.ndarray, most: float, settings: Settings) -> np.ndarray:
    """Hash strings, one row per tree, as integers whose leading bits are the string's first.

    ``most`` is the largest norm of all vectors: one more coordinate, which fills a vector's norm up to
    it, makes the largest inner product the smallest angle. Queries have 0 there, ``most`` = 0.
    """
    out = np.zeros((settings.trees, len(x)), np.int64)
    for at in range(0, len(x), 1000):
        part = x[at : at + 1000]
        lift = np.sqrt(np.maximum(0, most**2 - (part**2).sum(1)))
        y = (np.column_stack((part, lift)) @ planes(x.shape[1] + 1, settings)).reshape(len(part), settings.trees, settings.symbols, -1)
        place = np.abs(y).argmax(3)
        negative = np.take_along_axis(y, place[..., None], 3)[..., 0] < 0
        symbol = place + negative * settings.projections  # the sign first: a shorter prefix never joins opposite vectors alone
        for j in range(settings.symbols):
            out[:, at : at + len(part)] = out[:, at : at + len(part)] << settings.symbol_bits | symbol[:, :, j].T
    return out


def ascend(sample: np.ndarray, q: np.ndarray, want: float, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each tree and query the strings [low, high) below the prefix where the ascent ends.

    ``sample`` holds each tree's sorted strings; at the root the ranges hold everything.
    """
    low, high = np.zeros(q.shape, np.int64), np.full(q.shape, 1 << settings.bits, np.int64)
    open_ = np.arange(q.shape[1])
    for rest in range(settings.bits):
        prefix = q[:, open_] >> rest << rest
        held = sum(np.searchsorted(s, p + (1 << rest)) - np.searchsorted(s, p) for s, p in zip(sample, prefix, strict=True))
        done = held >= want
        low[:, open_[done]], high[:, open_[done]] = prefix[:, done], prefix[:, done] + (1 << rest)
        open_ = open_[~done]
        if not len(open_):
            break
    return low, high


class Cells:
    """Ranges of each tree's strings, cut at quantiles of a sample, and the salts of those that hold too much."""

    def __init__(self, sample: np.ndarray, asked: np.ndarray, rows: int, settings: Settings):
        self.sample, rate = np.sort(sample, 1), sample.shape[1] / max(1, rows)
        n = max(1, min(-(-rows // settings.cell_rows), sample.shape[1]))
        at = np.arange(1, n) * sample.shape[1] // n
        self.cuts = [np.unique(s[at]) for s in self.sample]
        base = 0
        self.base, self.row_salts, self.query_salts = [], [], []
        for t, cuts in enumerate(self.cuts):
            cell = np.searchsorted(cuts, sample[t], "right")
            held = np.bincount(cell, minlength=len(cuts) + 1) / rate
            met = np.bincount(cell[asked], minlength=len(cuts) + 1) / rate
            by_row = np.ceil(held / (2 * settings.cell_rows)).astype(np.int64).clip(1)
            by_query = np.ceil(met / settings.cell_queries).astype(np.int64).clip(1)
            size = by_row * by_query
            self.base.append(base + np.cumsum(size) - size)
            self.row_salts.append(by_row)
            self.query_salts.append(by_query)
            base += int(size.sum())

    def of_rows(self, tree: int, s: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part): a row is in one salt of its cell, for each salt of the queries."""
        cell = np.searchsorted(self.cuts[tree], s, "right")
        mine, copies = salt % self.row_salts[tree][cell], self.query_salts[tree][cell]
        of, nth = repeated(copies)
        return of, self.base[tree][cell[of]] + mine[of] * copies[of] + nth

    def of_queries(self, tree: int, low: np.ndarray, high: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, part): a query is in each cell its range meets, in one salt, for each salt of the rows."""
        first, last = np.searchsorted(self.cuts[tree], low, "right"), np.searchsorted(self.cuts[tree], high - 1, "right")
        of, nth = repeated(last - first + 1)
        cell = first[of] + nth
        again, nth = repeated(self.row_salts[tree][cell])
        of, cell = of[again], cell[again]
        copies = self.query_salts[tree][cell]
        return of, self.base[tree][cell] + nth * copies + salt[of] % copies


def repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 1): indices (0, 0, 1) and running numbers (0, 1, 0)."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def matrix(column: pa.ChunkedArray | pa.Array, kind: str, dims: int) -> np.ndarray:
    """Rows of raw numbers as a matrix in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(np.float64)


def best_of(x: np.ndarray, first_id: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` of the largest inner products with ``q`` and these, ties to the smaller first id."""
    rough = x @ q
    rows = np.arange(len(x))
    if len(x) > most:
        least = np.partition(rough, len(x) - most)[len(x) - most]
        rows = np.flatnonzero(rough >= least - 1e-9 * max(1.0, abs(least)))
    score = (x[rows] * q).sum(1)  # the same sum wherever a pair is met
    order = np.lexsort((first_id[rows], -score))[:most]
    return rows[order], score[order]


def usable(vectors: DataFrame) -> DataFrame:
    """The rows whose vector ``v`` takes part: not null, not zero, no null or non-finite component; ``id`` not null."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda c: c != 0))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(key, v, ids, asked) of each distinct vector: its ``most`` smallest ids, and whether some row of it is a query."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    kept = rows.withColumn("nth", nth).where(F.col("nth") <= most)  # limited before the shuffle too
    classes = kept.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.where("asked").select("key").distinct().withColumn("asked", F.lit(True))
    return classes.join(asked, "key", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def nearest(vectors: DataFrame, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """The nearest rows of ``vectors`` (vec_id, embedding) to those where ``is_query`` holds, by inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, and a row isn't its
    own neighbour. Vectors that are null, zero, or hold null or non-finite components take no part.
    Shorter vectors are read as if zeros followed. Rows of equal vec_id are rows of their own: each is
    searched, and found, as often as it is there. An empty table gives no rows; other columns of
    ``vectors``, whatever their names, are not read.
    """
    item = "float" if "array<float>" in dict(vectors.dtypes)["embedding"] else "double"
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(f"array<{item}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    known = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("dims"), F.sqrt(F.max(square)).alias("norm")).first()
    if not known["dims"]:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    dims, norm = known["dims"], float(known["norm"])
    if known["least"] < dims:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast(item), dims - F.size("v"))))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat_ws(",", F.col("v").cast("array<string>")).cast("binary"))))
    keep = settings.neighbours + 1
    classes = written(distinct_vectors(rows, keep))
    count = classes.count()
    kind = "<f4" if item == "float" else "<f8"

    def each(batches):
        for b in tidied(batches):
            v = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
            yield b, v

    # a bounded sample of the strings foretells how many rows are below a prefix
    share = min(1.0, settings.sample_rows / count)
    drawn = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)) or 1))

    def hash_sample(batches):
        for b, v in each(batches):
            s = strings(v, norm, settings).T
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in np.ascontiguousarray(s)], pa.binary()), b.column(2)], names=["s", "asked"])

    sample = drawn.select("key", "v", "asked").mapInArrow(hash_sample, "s binary, asked boolean").collect()
    sample.sort(key=lambda r: r["s"])
    found = np.frombuffer(b"".join(bytes(r["s"]) for r in sample), np.int64).reshape(-1, settings.trees).T if sample else np.zeros((settings.trees, 1), np.int64)
    cells = Cells(found, np.array([r["asked"] for r in sample] or [False], bool), count, settings)
    rate = found.shape[1] / count
    want = max(settings.reach * count**settings.growth * rate, 2.0 * settings.trees * keep)  # at the least so many that the neighbours are among them

    def deal_rows(batches):
        for b, v in each(batches):
            s = strings(v, norm, settings)
            raw = pa.array([r.tobytes() for r in v.astype(kind)], pa.binary())
            salt = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4").reshape(len(v), 4)[:, 0].astype(np.int64)
            for t in range(settings.trees):
                of, part = cells.of_rows(t, s[t], salt)
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(s[t]).take(of), b.column(0).take(of), b.column(2).take(of), raw.take(of)], names=["part", "s", "key", "ids", "raw"])

    def deal_queries(batches):
        for b, v in each(batches):
            low, high = ascend(cells.sample, strings(v, 0.0, settings), want, settings)
            raw = pa.array([r.tobytes() for r in v.astype(kind)], pa.binary())
            salt = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4").reshape(len(v), 4)[:, 1].astype(np.int64)
            for t in range(settings.trees):
                of, part = cells.of_queries(t, low[t], high[t], salt)
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(low[t]).take(of), pa.array(high[t]).take(of), b.column(0).take(of), raw.take(of)], names=["part", "low", "high", "query", "raw"])

    dealt = classes.select("key", "v", "ids").mapInArrow(deal_rows, "part long, s long, key binary, ids array<long>, raw binary")
    asking = classes.where("asked").select("key", "v").mapInArrow(deal_queries, "part long, low long, high long, query binary, raw binary")
    hit = pa.struct([("score", pa.float64()), ("key", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def meet(part, a: pa.Table, b: pa.Table) -> pa.Table:
        queries, hits = [], []
        if a.num_rows and b.num_rows:
            s = a.column("s").to_numpy()
            order = np.argsort(s, kind="stable")
            s, x = s[order], matrix(a.column("raw"), kind, dims)[order]
            ids, keys = a.column("ids").to_pylist(), a.column("key").to_pylist()
            first_id = np.array([i[0] for i in ids], np.int64)[order]
            lo, hi = np.searchsorted(s, b.column("low").to_numpy()), np.searchsorted(s, b.column("high").to_numpy())
            for k, (name, q) in enumerate(zip(b.column("query").to_pylist(), matrix(b.column("raw"), kind, dims), strict=True)):
                if hi[k] > lo[k]:
                    at, score = best_of(x[lo[k] : hi[k]], first_id[lo[k] : hi[k]], q, keep)
                    queries.append(name)
                    hits.append([{"score": z, "key": keys[j], "ids": ids[j]} for j, z in zip(order[lo[k] + at].tolist(), score.tolist(), strict=True)])
        return pa.table({"query": pa.array(queries, pa.binary()), "hits": pa.array(hits, pa.list_(hit))})

    per_cell = dealt.groupBy("part").cogroup(asking.groupBy("part")).applyInArrow(meet, "query binary, hits array<struct<score:double,key:binary,ids:array<long>>>")
    ordered = F.transform(F.flatten(F.collect_list("hits")), lambda h: F.struct((-h["score"]).alias("less"), h["ids"][0].alias("first"), h["key"].alias("key"), h["ids"].alias("ids")))
    best = per_cell.groupBy("query").agg(F.slice(F.sort_array(F.array_distinct(ordered)), 1, keep).alias("best"))

    # back to the rows that asked; a vector that many rows have is spread over salts
    salts = 8
    best = best.select(F.col("query").alias("key"), "best", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    mine = rows.where("asked").select("id", "key", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    both = mine.join(best, ["key", "salt"])
    own = F.col("id")

    def others(h: Column) -> Column:
        """The ids of a hit but for one of the row itself."""
        at = F.when(h["key"] == F.col("key"), F.array_position(h["ids"], own)).otherwise(0)
        return F.filter(h["ids"], lambda _, i: i + 1 != at)

    pairs = F.flatten(F.transform("best", lambda h: F.transform(others(h), lambda i: F.struct(h["less"].alias("less"), i.alias("vec_id")))))
    top = both.select(own.alias("query_id"), F.posexplode(F.slice(F.sort_array(pairs), 1, settings.neighbours)).alias("pos", "hit"))
    return top.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def op6_hash_prefix_forest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector, by inner product; an empty table gives no rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
