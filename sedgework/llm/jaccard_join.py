"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each text becomes its set of hashed word shingles; texts with equal sets are one class, and only
   one representative of a class goes on.
2. Representatives meet in the buckets of a banded MinHash (``bands`` x ``rows``; a pair at the
   threshold 0.8 shares no bucket with a probability below 1e-7). Inside a bucket MinHash values are
   compared step by step; a pair is dropped once the posterior probability that its similarity
   reaches the threshold is below ``tolerance``. A bucket returns a spanning forest of the pairs that
   are left, not the pairs.
3. Connected buckets make candidate groups. All pairs of a group are verified exactly by products of
   0/1 shingle matrices. Groups are cut into blocks, so that no task holds more than two blocks; a
   block pair returns link counts and a spanning forest of the true links.
4. Connected components of the true links are the groups of near-duplicates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgework.llm.common import Bounded, forget, mix64, slices, table, tidied, tidy, written

WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """``broadcast_rows``: hashes of candidates (8 bytes each) that are broadcast to filter the texts, at most."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 4
    tolerance: float = 1e-6
    steps: tuple[int, ...] = (16, 32, 64, 128)
    block: int = 512
    verify_block: int = 192
    broadcast_rows: int = 2_000_000


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; a text of fewer words is one shingle of them all."""

    def __init__(self, words: int):
        self.k = words
        self.known = Bounded(word_hash)
        self.odd = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(words)]

    def __call__(self, text: str | None) -> np.ndarray:
        found = WORDS.findall(text.lower()) if text else []
        if not found:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        n = max(1, len(h) - self.k + 1)
        out = np.full(n, np.uint64(min(len(h), self.k)))
        for i in range(min(self.k, len(h))):
            out += h[i : i + n] * self.odd[i]
        return np.unique(mix64(out))


@lru_cache(2)
def multipliers(n: int) -> np.ndarray:
    rng = np.random.default_rng(2024)
    return rng.integers(0, 1 << 32, (2, n), dtype=np.uint64).astype(np.uint32) | np.array([[1], [0]], np.uint32)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash values (uint32) of non-empty sets."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    a, b = multipliers(n)
    out = np.empty((len(sets), n), np.uint32)
    x = np.empty_like(flat)
    for j in range(n):
        np.multiply(flat, a[j], out=x)
        x += b[j]
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x45D9F3B)
        out[:, j] = np.minimum.reduceat(x, starts)
    return out


@lru_cache(4)
def least_matches(settings: Settings) -> tuple[int, ...]:
    """For each step of n compared values the fewest matches m with P(J >= threshold | m, n) >= tolerance.

    Eight bits of a value are compared, so unequal values look equal in one case of 256. The prior of
    the chance to look equal is uniform, so its posterior is a beta distribution.
    """
    reach = settings.threshold + (1 - settings.threshold) / 256
    x = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in settings.steps:
        need = n + 1
        for m in range(n, -1, -1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(log - log.max())
            if p[x >= reach].sum() / p.sum() < settings.tolerance:
                break
            need = m
        out.append(need)
    return tuple(out)


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, settings: Settings) -> np.ndarray:
    """Which pairs of rows survive the incremental comparison of their MinHash values."""
    alive, same, done = np.arange(len(i)), np.zeros(len(i), np.int32), 0
    for n, need in zip(settings.steps, least_matches(settings), strict=True):
        same = same + (sig[i[alive], done:n] == sig[j[alive], done:n]).sum(1, dtype=np.int32)
        ok = same >= need
        alive, same, done = alive[ok], same[ok], n
    return alive


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs, each node linked to the smallest one of its tree."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return [(k, int(low[k])) for k in np.flatnonzero(low != np.arange(n)).tolist()]


def sketch(docs: DataFrame, settings: Settings) -> DataFrame:
    """(uid, doc_id, set_key, bands, short) of each row of (uid, doc_id, text): the hash of its shingle set, the bucket of
    each band and eight bits of each MinHash value; all null if there are no words."""
    n, r = settings.bands * settings.rows, settings.rows
    odd = np.array([[pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(r)]], np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        shingle = Shingler(settings.words)
        for b in tidied(batches):
            lengths = [len(t) if isinstance(t, str) else 0 for t in b["text"]]
            for part in slices(lengths, 3_000_000):
                sub = b.iloc[part]
                sets = [shingle(t if isinstance(t, str) else None) for t in sub["text"]]
                full = [s for s in sets if len(s)]
                sig = signatures(full, n) if full else np.zeros((0, n), np.uint32)
                bands = mix64((sig.reshape(-1, settings.bands, r).astype(np.uint64) * odd).sum(2, dtype=np.uint64) + np.arange(settings.bands, dtype=np.uint64)).astype(np.int64)
                each = iter(zip(bands, (row.tobytes() for row in sig.astype(np.uint8)), strict=True))
                out = [(xxhash.xxh3_128_hexdigest(s.tobytes()), *next(each)) if len(s) else (None, None, None) for s in sets]
                yield pd.DataFrame({"uid": sub["uid"].tolist(), "id_text": sub["id_text"].tolist(), "set_key": [x[0] for x in out], "bands": [x[1] for x in out], "short": [x[2] for x in out]}, dtype=object)

    # the id goes through as text: whole numbers with nulls are no exact numbers in pandas
    kind = docs.schema["doc_id"].dataType
    out = docs.select("uid", F.col("doc_id").cast("string").alias("id_text"), "text").mapInPandas(run, "uid string, id_text string, set_key string, bands array<long>, short binary")
    return out.select("uid", F.col("id_text").cast(kind).alias("doc_id"), "set_key", "bands", "short")


def blocks(members: DataFrame, key: str, size: int, unit: str) -> DataFrame:
    """Deal the members of each group into block pairs: adds ``cell`` and ``own`` (the member's block).

    A group of up to ``size`` members is one cell; a larger one of b blocks becomes b(b+1)/2 cells,
    so that each pair of members meets in at least one. Groups of one member go. The counts grow with
    the input, so they are merged at every size, never broadcast.
    """
    counts = members.groupBy(key).agg(F.count("*").alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") / size).cast("int")
    own = F.pmod(F.xxhash64(unit), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return (
        members.join(counts.withColumn("parts", parts).hint("merge"), key)
        .withColumn("own", own)
        .withColumn("other", other)
        .withColumn("cell", F.concat_ws(":", F.col(key).cast("string"), F.least("own", "other"), F.greatest("own", "other")))
        .drop("members", "parts", "other")
    )


def candidates(reps: DataFrame, settings: Settings) -> DataFrame:
    """Edges (a, b) between units (hashed class keys): a spanning forest of the surviving pairs of each bucket."""
    reps = reps.withColumn("unit", F.xxhash64("set_key"))
    rows = reps.select("unit", F.explode("bands").alias("bucket"))
    cells = blocks(rows, "bucket", settings.block, "unit").select(F.xxhash64("cell").alias("cell"), "unit")
    # in the order of units the root of a tree is its smallest unit, so that the bands of a group repeat the same edges
    dealt = cells.join(reps.select("unit", "short"), "unit").select("cell", "unit", "short").repartition("cell").sortWithinPartitions("cell", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a cell follow one another; the last cell of a batch waits for the next batch."""
        width = settings.bands * settings.rows
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.uint8))

        def edges(cell: np.ndarray, unit: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
            out = set()
            ends = (np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist()
            for lo, hi in zip([0, *ends], [*ends, len(cell)], strict=True):
                i, j = np.triu_indices(hi - lo, 1)
                for at in range(0, len(i), 100_000):
                    p, q = i[at : at + 100_000], j[at : at + 100_000]
                    ok = surviving(sig[lo:hi], p, q, settings)
                    out.update((int(unit[lo + x]), int(unit[lo + y])) for x, y in forest(hi - lo, p[ok], q[ok]))
            pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for b in tidied(batches):
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, width)
            cell, unit, sig = (np.concatenate(x) for x in zip(held, (b.column(0).to_numpy(), b.column(1).to_numpy(), sig), strict=True))
            if not len(cell):
                continue
            first = int(np.searchsorted(cell, cell[-1]))
            held = cell[first:], unit[first:], sig[first:]
            if first:
                yield edges(cell[:first], unit[:first], sig[:first])
        if len(held[0]):
            yield edges(*held)

    return dealt.mapInArrow(run, "a long, b long").dropDuplicates()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node of each connected component of edges (a, b); isolated nodes are absent.

    Large-star and small-star steps by turns (Kiveris et al. 2014): each shuffles the edges by node and
    uses a minimum that is combined before the shuffle; the path lengths fall geometrically. The first
    step gathers the smaller neighbours of each node, which are few (one for each cell it was in), and
    so shrinks the forests of all cells of a group to about one edge for each node.
    """
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = oriented.groupBy("a").agg(F.collect_set("b").alias("n"), F.min("b").alias("m"))
    starred = near.select("m", F.explode(F.transform("n", lambda x: F.when(x == F.col("m"), F.col("a")).otherwise(x))).alias("a"))
    edges = written(starred.select("a", F.col("m").alias("b")).dropDuplicates())
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).dropDuplicates())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).dropDuplicates()).groupBy("node").agg(F.min("root").alias("root"))
        seen = (now["n"], now["h"])
    raise RuntimeError("the components did not settle")


def links(cell: list[tuple[int, str, np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a cell with an exact similarity of at least the threshold; of equal blocks each pair once.

    In a cell of two blocks only pairs across them count (each block has a cell of its own).
    """
    own = np.array([x[0] for x in cell])
    sizes = np.array([len(x[2]) for x in cell])
    flat, row = np.concatenate([x[2] for x in cell]), np.repeat(np.arange(len(cell)), sizes)
    _, col, many = np.unique(flat, return_inverse=True, return_counts=True)
    keep = many[col] > 1  # a shingle of one member adds to no intersection
    col, row = (np.cumsum(many > 1) - 1)[col[keep]], row[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    common = np.zeros((len(cell), len(cell)), np.float32)
    step = max(256, 4_000_000 // len(cell))
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        lo, hi = np.searchsorted(col, [at, at + step])
        m = np.zeros((len(cell), step), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        common += m @ m.T
    i, j = np.triu_indices(len(cell), 1)
    if len(set(own.tolist())) > 1:
        across = own[i] != own[j]
        i, j = i[across], j[across]
    n = common[i, j].astype(np.int64)
    ok = n >= threshold * (sizes[i] + sizes[j] - n) - 1e-9
    return i[ok], j[ok]


def verified(texts: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, n): n > 0 counts links of ``a`` (then b is null), other rows are edges of a spanning forest of links."""
    dealt = blocks(groups.select("set_key", "root"), "root", settings.verify_block, "set_key")
    known = Shingler(settings.words)
    # all cells of a text meet it in one row, so that each text is moved to the join once
    per_text = dealt.groupBy("set_key").agg(F.collect_list(F.struct("cell", "own")).alias("cells"))
    rows = per_text.join(texts, "set_key").select("set_key", "text", F.explode("cells").alias("c")).select("c.cell", "c.own", "set_key", "text")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shingle = known
        pdf = pdf.sort_values("set_key")
        i, j = links([(o, k, shingle(t)) for o, k, t in zip(pdf["own"], pdf["set_key"], pdf["text"], strict=True)], settings.threshold)
        keys = pdf["set_key"].tolist()
        count = np.bincount(np.concatenate([i, j]), minlength=len(keys))
        some = np.flatnonzero(count)
        tree = forest(len(keys), i, j)
        out = [(keys[x], None, int(count[x])) for x in some] + [(keys[x], keys[y], 0) for x, y in tree]
        return pd.DataFrame(out, columns=["a", "b", "n"], dtype=object)

    return rows.groupBy("cell").applyInPandas(run, "a string, b string, n long")


def uid():
    return F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lower(F.hex(F.xxhash64("text"))))


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of the smallest doc_id stays."""
    found = near_duplicates(docs, settings)
    first = found.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first"))
    kept = first.select(F.col("first.uid").alias("__uid"))
    own = docs.withColumn("__uid", uid()).join(kept, "__uid", "left_semi")
    # of rows equal in id and text the one whose other columns come first
    nth = F.row_number().over(Window.partitionBy("__uid").orderBy(F.xxhash64(*docs.columns)))
    return own.withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Group the rows of ``docs`` (doc_id, text) whose sets of word shingles are alike.

    One row for each row of ``docs``: uid (of its doc_id and text), group_key, doc_id, class_id (the smallest doc_id of the rows with an equal
    shingle set), group_id (the smallest doc_id of all rows that links connect), n_links (how many
    other classes are linked to the row's class), n_copies (rows of its class). Null texts and texts
    without words form no class: class_id and group_id are their own doc_id. Rows with equal doc_id
    are told apart by their text; rows equal in both share a class.
    """
    base = docs.select("doc_id", "text").withColumn("uid", uid())
    sketched = written(sketch(base, settings))
    known = sketched.where("set_key is not null")
    # one signature and one text stand for a class
    one = F.min_by(F.struct("uid", "bands", "short"), "uid").alias("one")
    reps = written(known.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"), one).select("set_key", "class_id", "n_copies", "one.*"))
    classes = reps.select("set_key", "class_id", "uid", "n_copies")
    edges = written(candidates(reps.select("set_key", "bands", "short"), settings))
    named = classes.select("set_key", "uid", F.xxhash64("set_key").alias("node"))
    groups = written(components(edges).join(named, "node").select("set_key", "uid", "root"))
    wanted = groups.select("uid", "set_key")
    few = base.select("uid", "text")
    if groups.count() <= settings.broadcast_rows:  # 8 bytes a row; beyond that all texts go to the join
        few = few.withColumn("key", F.xxhash64("uid")).join(F.broadcast(wanted.select(F.xxhash64("uid").alias("key")).distinct()), "key", "left_semi").drop("key")
    texts = few.join(wanted, "uid").dropDuplicates(["set_key"]).select("set_key", "text")
    found = written(verified(texts, groups, settings))
    count = found.where("n > 0").groupBy(F.col("a").alias("set_key")).agg(F.sum("n").alias("n_links"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "set_key")
    with_root = classes.join(roots, "set_key", "left").join(count, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    low = with_root.groupBy("root").agg(F.min("class_id").alias("group_id"))
    labelled = with_root.join(low, "root").select("set_key", "root", "class_id", "group_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("n_copies").cast("bigint").alias("n_copies"))
    return sketched.select("uid", "doc_id", "set_key").join(labelled, "set_key", "left").select("uid", F.coalesce("root", "uid").alias("group_key"), "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"))


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Class, group, links and copies of every document; texts without words are classes of their own, an empty table gives no rows."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_id", "n_links", "n_copies")
