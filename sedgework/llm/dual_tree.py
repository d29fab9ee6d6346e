"""Hard negatives by dual-tree search.

Rows are dealt to the leaves of one tree of half-spaces, and the anchors lie in the same leaves. A leaf has a
ball around its rows and one around its anchors, so that two leaves have an interval of inner products: it
says for all anchors of the one at once whether any row of the other can matter, and only pairs that can are
brought together, in blocks of bounded size. Inside of such a pair both sides get trees of their own, walked
together from the roots: a pair of nodes is left where its interval lies below what every anchor of the
node still needs or above what any may take; pairs of leaves are scored exactly.

Positives are found first (in the anchors' own leaves, which gives each anchor a score to beat, then in all
others that can beat it), then the negatives between the bounds that the positives set.

The half-spaces come from a bounded sample (``Settings.sample_values`` numbers), the balls from all rows. Vectors
without any structure have wide intervals: little is pruned, and the work is that of scoring all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.llm.common import table, tidied, written


@dataclass(frozen=True)
class Settings:
    """Components are ``floor(scale * x)``; a negative scores from ``least`` hundredths of its positive's score up to it."""

    positives: int = 5
    negatives: int = 5
    scale: int = 256
    least: int = 80
    sample_values: int = 1 << 21
    leaves: int = 1024
    #: rows of a block, times the root of the number of rows (so rows and anchors are copied about as often)
    block: float = 4.0
    block_least: int = 256
    #: anchors that meet a block at once
    chunk: int = 16_384
    node: int = 64


EMPTY, ANY = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def cut(x: np.ndarray, least: int) -> tuple[np.ndarray, float] | None:
    """A line and a place on it that part the rows: in the widest gap that leaves ``least`` rows on both sides, if it is wide, else at the median."""
    if len(x) < 2:
        return None
    far = x[((x - x[0]) ** 2).sum(1).argmax()]
    line = x[((x - far) ** 2).sum(1).argmax()] - far
    place = np.sort(x @ line)
    if place[0] == place[-1]:
        return None
    gaps = np.diff(place)[least - 1 : len(place) - least]
    if len(gaps) and gaps.max() > 0.1 * (place[-1] - place[0]):
        k = int(gaps.argmax()) + least - 1
        return line, float(place[k] + place[k + 1]) / 2
    at = float(place[(len(place) - 1) // 2])
    return line, at if at < place[-1] else float(place[np.searchsorted(place, at) - 1])


class Halves:
    """A tree of half-spaces: the node of the largest sample is cut along the line between two far rows."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.lines: list[tuple[np.ndarray, float, int, int] | None] = [None]
        self.leaf, parts = {}, [(0, np.arange(len(sample)))]
        queue = parts.copy()
        while queue and len(queue) < leaves:  # the largest is split first
            k = max(range(len(queue)), key=lambda i: len(queue[i][1]))
            node, rows = queue[k]
            cut_ = cut(sample[rows], max(1, len(sample) // (4 * leaves)))
            if cut_ is None:
                break
            line, at = cut_
            side = sample[rows] @ line > at
            queue[k] = (len(self.lines), rows[~side])
            queue.append((len(self.lines) + 1, rows[side]))
            self.lines[node] = (line, at, len(self.lines), len(self.lines) + 1)
            self.lines += [None, None]
        self.leaf = {node: i for i, (node, _) in enumerate(queue)}
        self.centres = np.array([sample[rows].mean(0) if len(rows) else np.zeros(sample.shape[1]) for _, rows in queue])

    def of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.lines[node] is None:
                out[rows] = self.leaf[node]
            elif len(rows):
                line, at, left, right = self.lines[node]
                side = x[rows] @ line > at
                todo += [(left, rows[~side]), (right, rows[side])]
        return out


class Balls:
    """A tree over a block's rows, cut as the half-spaces are, with a ball around each node's rows."""

    def __init__(self, x: np.ndarray, most: int):
        self.order = np.arange(len(x))
        self.low, self.high, self.left, self.centre, self.radius = [], [], [], [], []
        self.add(x, 0, len(x))
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = self.low[node], self.high[node]
            rows = x[self.order[a:b]]
            found = cut(rows, max(1, most // 2)) if b - a > most else None
            if found is None:
                continue
            side = rows @ found[0] > found[1]
            middle = a + int((~side).sum())
            if middle in (a, b):  # rounding alone tells the rows apart
                continue
            self.order[a:b] = np.concatenate([self.order[a:b][~side], self.order[a:b][side]])
            self.left[node] = len(self.low)
            for c, d in ((a, middle), (middle, b)):
                todo.append(len(self.low))
                self.add(x, c, d)
        self.norm = [float(np.linalg.norm(c)) for c in self.centre]

    def add(self, x: np.ndarray, a: int, b: int) -> None:
        rows = x[self.order[a:b]]
        centre = rows.mean(0)
        self.low.append(a)
        self.high.append(b)
        self.left.append(-1)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((rows - centre) ** 2).sum(1).max())))


def slack(reach):
    """Room for rounding around an interval's end."""
    return 1.0 + 1e-9 * np.abs(reach)


def interval(p: float, norm_a: float, radius_a: float, norm_b: float, radius_b: float) -> tuple[float, float]:
    """Least and largest inner product of two balls whose centres' product is ``p``."""
    spread = norm_a * radius_b + norm_b * radius_a + radius_a * radius_b
    return p - spread - slack(p) - 1e-9 * spread, p + spread + slack(p) + 1e-9 * spread


class Search:
    """The best rows of one block for a chunk of anchors.

    Each anchor has several slots with the least and largest score wanted; ``same`` says whether labels
    must agree or differ. Better is a larger score, then a smaller id, then a smaller row number.
    """

    def __init__(self, a: dict, c: dict, keep: int, same: bool, node: int, exact: bool):
        self.a, self.c, self.same, self.keep, self.exact = a, c, same, keep, exact
        shape = (*a["least"].shape, keep)
        self.score, self.id, self.row = np.full(shape, EMPTY), np.full(shape, ANY), np.full(shape, ANY)
        self.trees = Balls(a["x"], node), Balls(c["x"], node)
        self.need = np.maximum(a["least"], EMPTY + 1)
        self.cap = a["most"].max(1)

    def run(self) -> None:
        """Walk pairs of nodes, those of the largest possible score first."""
        anchors, rows = self.trees
        heap: list[tuple[float, int, int]] = []

        def useless(a: int, low: float, high: float) -> bool:
            here = anchors.order[anchors.low[a] : anchors.high[a]]
            return high < self.need[here].min() or low > self.cap[here].max()

        def add(a: int, c: int) -> None:
            low, high = interval(float(anchors.centre[a] @ rows.centre[c]), anchors.norm[a], anchors.radius[a], rows.norm[c], rows.radius[c])
            if not useless(a, low, high):
                heappush(heap, (-high, a, c))

        add(0, 0)
        while heap:
            high, a, c = heappop(heap)
            la, lc = anchors.left[a], rows.left[c]
            if useless(a, -np.inf, -high):  # what was found meanwhile is better
                continue
            if la < 0 and lc < 0:
                self.score_pair(anchors.order[anchors.low[a] : anchors.high[a]], rows.order[rows.low[c] : rows.high[c]])
            elif lc < 0 or la >= 0 and anchors.radius[a] > rows.radius[c]:
                add(la, c)
                add(la + 1, c)
            else:
                add(a, lc)
                add(a, lc + 1)

    def score_pair(self, here: np.ndarray, there: np.ndarray) -> None:
        a, c = self.a, self.c
        if self.exact:
            s = (a["x"][here] @ c["x"][there].T).astype(np.int64)
        else:
            s = a["whole"][here] @ c["whole"][there].T
        agree = (a["label"][here][:, None] == c["label"][there]) == self.same
        agree &= a["row"][here][:, None] != c["row"][there]
        ids, rows = c["id"][there], c["row"][there]
        for k in range(a["least"].shape[1]):
            fits = agree & (s >= self.need[here, k][:, None]) & (s <= a["most"][here, k][:, None])
            hit = np.flatnonzero(fits.any(1))
            if not len(hit):
                continue
            at = here[hit]
            wide = (len(hit), len(there))
            score = np.concatenate([self.score[at, k], np.where(fits[hit], s[hit], EMPTY)], 1)
            id_ = np.concatenate([self.id[at, k], np.where(fits[hit], ids, ANY)], 1)
            row = np.concatenate([self.row[at, k], np.broadcast_to(rows, wide)], 1)
            best = np.lexsort((row, id_, -np.maximum(score, -ANY)), axis=-1)[:, : self.keep]
            for mine, new in ((self.score, score), (self.id, id_), (self.row, row)):
                mine[at, k] = np.take_along_axis(new, best, 1)
            self.need[at, k] = np.maximum(a["least"][at, k], self.score[at, k, -1])

    def hits(self) -> pa.Table:
        """A row for each anchor, slot and row kept."""
        of, slot, nth = np.nonzero(self.score != EMPTY)
        values = [self.a["row"][of], slot, self.id[of, slot, nth], self.row[of, slot, nth], self.score[of, slot, nth]]
        return pa.table([pa.array(v.astype(np.int64)) for v in values], names=HIT)


HIT = ["anchor", "slot", "found_id", "found_row", "score"]
HITS = "anchor long, slot long, found_id long, found_row long, score long"


def quantised(vectors: DataFrame, settings: Settings) -> DataFrame:
    """The rows that take part: id, label, v (whole numbers), asked."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(settings.scale * x.cast("double")).cast("bigint"))
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"), F.coalesce("asked", F.lit(False)).alias("asked"))


def best_of(hits: DataFrame, keep: int) -> DataFrame:
    """The first hits of each anchor and slot, with their rank."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "found_id", "found_row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(vectors: DataFrame, is_anchor: Column, settings: Settings | None = None) -> DataFrame:
    """For each anchor of ``vectors`` (vec_id, embedding, label) and each of its positives the negatives that are nearly as near.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Scores are inner
    products of the whole-numbered components; ties go to the smaller vec_id. Rows with a null id or label, a null vector,
    or a null or non-finite component take no part. Shorter vectors are read as if zeros followed (an empty
    one is all zeros). Repeated rows and rows of equal vec_id are rows of their own; only the anchor's own row is
    not its positive. An empty table gives no rows. Other columns are not read. Scores fit a long, as the result's type asks.
    """
    want = settings or Settings()
    rows = quantised(vectors.select("vec_id", "embedding", "label", is_anchor.alias("asked")), want)
    size = F.aggregate("v", F.lit(0).cast("bigint"), lambda m, x: F.greatest(m, F.abs(x)))
    known = rows.agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("long")).alias("asked"), F.max(F.size("v")).alias("dims"), F.max(size).alias("most")).first()
    n, dims, most = known["n"], max(1, known["dims"] or 0), known["most"] or 0
    kind = next(k for k, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", ANY)) if most < top or k == "<i8")
    exact = float(most) ** 2 * dims < 2.0**53  # sums in double precision are exact then

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)

    # half-spaces from a bounded sample, a leaf and its distance from the leaf's centre for each row
    draw = max(1, want.sample_values // dims)
    chance = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)) < F.lit(int(min(1.0, draw / max(1, n)) * (1 << 40)) or 1)
    sample = np.zeros((0, dims))
    drawn = rows.where(chance).select("id", "v").collect()
    if drawn:
        sample = np.array([r["v"] + [0] * (dims - len(r["v"])) for r in sorted(drawn, key=lambda r: (r["id"], r["v"]))], np.float64)
    block = max(want.block_least, int(want.block * n**0.5))
    halves = Halves(sample, max(1, min(want.leaves, -(-n // block))))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            v = np.zeros((b.num_rows, dims), np.int64)
            lengths = np.diff(b.column(2).offsets.to_numpy())
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False)
            v[np.arange(dims) < lengths[:, None]] = flat
            x = v.astype(np.float64)
            leaf = halves.of(x)
            away = np.sqrt(((x - halves.centres[leaf]) ** 2).sum(1))
            raw = pa.array([r.tobytes() for r in v.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), raw, pa.array(leaf), pa.array(away)], names=["id", "label", "asked", "raw", "leaf", "away"])

    dealt = rows.mapInArrow(routed, "id long, label long, asked boolean, raw binary, leaf long, away double")
    dealt = written(dealt.withColumn("row", F.monotonically_increasing_id()))
    leaves = len(halves.centres)
    held, spread, reach = np.zeros(leaves, np.int64), np.zeros(leaves), np.full(leaves, -1.0)
    for r in dealt.groupBy("leaf").agg(F.count("*").alias("n"), F.max("away").alias("far"), F.max(F.when(F.col("asked"), F.col("away"))).alias("reach")).collect():
        held[r["leaf"]], spread[r["leaf"]], reach[r["leaf"]] = r["n"], r["far"], -1.0 if r["reach"] is None else r["reach"]
    parts = np.maximum(1, -(-held // block))
    first = np.cumsum(parts) - parts
    chunks = max(1, -(-(known["asked"] or 0) // want.chunk))
    centre, norm = halves.centres, np.linalg.norm(halves.centres, axis=1)
    cross = centre @ centre.T
    low, high = interval(cross, norm[:, None], np.maximum(reach, 0)[:, None], norm[None, :], spread[None, :])
    asking = (reach >= 0)[:, None] & (held > 0)[None, :]

    def search(anchors: DataFrame, meets: np.ndarray, keep: int, same: bool) -> DataFrame:
        """The best of the leaves that ``meets`` says, for anchors (row, label, raw, leaf, least, most)."""
        wanted = meets.any(0)

        def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf, row = b.column(3).to_numpy(), b.column(4).to_numpy()
                at = np.flatnonzero(wanted[leaf])
                unit = (first[leaf[at]] + row[at] % parts[leaf[at]]) * chunks
                for k in range(chunks):
                    yield pa.RecordBatch.from_arrays([pa.array(unit + k), *(b.column(i).take(pa.array(at)) for i in (0, 1, 2, 4))], names=["unit", "id", "label", "raw", "row"])

        def deal_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf, row = b.column(3).to_numpy(), b.column(0).to_numpy()
                x = matrix(b.column(2)).astype(np.float64)
                least = b.column(4).flatten().to_numpy().reshape(len(row), -1).min(1)
                near, far = interval(x @ centre.T, np.linalg.norm(x, axis=1)[:, None], 0.0, norm[None, :], spread[None, :])
                top = b.column(5).flatten().to_numpy().reshape(len(row), -1).max(1)
                of, to = np.nonzero(meets[leaf] & (far >= least[:, None]) & (near <= top[:, None]))
                again = np.repeat(np.arange(len(of)), parts[to])
                nth = np.arange(len(again)) - np.repeat(np.cumsum(parts[to]) - parts[to], parts[to])
                unit = (first[to[again]] + nth) * chunks + row[of[again]] // 7 % chunks
                for a in range(0, len(unit), 20_000):
                    take = pa.array(of[again[a : a + 20_000]])
                    yield pa.RecordBatch.from_arrays([pa.array(unit[a : a + 20_000]), *(b.column(i).take(take) for i in (0, 1, 2, 4, 5))], names=["unit", "row", "label", "raw", "least", "most"])

        def meet(c: pa.Table, a: pa.Table) -> pa.Table:
            if not (c.num_rows and a.num_rows):
                return pa.table([pa.array([], pa.int64())] * len(HIT), names=HIT)
            sides = []
            for t in (a, c):
                whole = matrix(t.column("raw"))
                side = {"x": whole.astype(np.float64), "row": t.column("row").to_numpy(), "label": t.column("label").to_numpy()}
                sides.append(side if exact else side | {"whole": whole.astype(np.int64)})
            sides[0] |= {k: pa.chunked_array(a.column(k).chunks).combine_chunks().flatten().to_numpy().reshape(a.num_rows, -1) for k in ("least", "most")}
            sides[1]["id"] = c.column("id").to_numpy()
            found = Search(*sides, keep, same, want.node, exact)
            found.run()
            return found.hits()

        left = dealt.select("id", "label", "raw", "leaf", "row").mapInArrow(deal_rows, "unit long, id long, label long, raw binary, row long")
        right = anchors.select("row", "label", "raw", "leaf", "least", "most").mapInArrow(deal_anchors, "unit long, row long, label long, raw binary, least array<long>, most array<long>")
        return left.groupBy("unit").cogroup(right.groupBy("unit")).applyInArrow(meet, HITS)

    anchors = dealt.where("asked").select("row", "id", "label", "raw", "leaf")
    longs = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])

    # positives: first of the anchors' own leaves, then of all leaves that can hold better ones
    home = np.eye(leaves, dtype=bool) & asking
    own = written(best_of(search(anchors.withColumn("least", longs(EMPTY + 1)).withColumn("most", longs(ANY)), home, want.positives, True), want.positives).select(*HIT))
    fifth = own.groupBy(F.col("anchor").alias("row")).agg(F.when(F.count("*") >= want.positives, F.min("score")).alias("fifth"))
    seeded = written(anchors.join(fifth, "row", "left").withColumn("fifth", F.coalesce("fifth", F.lit(EMPTY + 1))))
    beat = np.full(leaves, np.inf)
    for r in seeded.groupBy("leaf").agg(F.min("fifth").alias("fifth")).collect():
        beat[r["leaf"]] = float(r["fifth"])
    meets = asking & ~home & (high >= beat[:, None])
    rest = search(seeded.withColumn("least", F.array("fifth")).withColumn("most", longs(ANY)), meets, want.positives, True)
    positives = written(best_of(own.unionByName(rest), want.positives).select("anchor", (F.col("rank") - 1).cast("long").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # negatives: a slot for each positive; a slot without one wants nothing
    per = positives.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "positive_score"))).alias("scores"))
    score = lambda k: F.try_element_at("scores", F.lit(k).cast("long"))
    slots = range(want.positives)
    least = F.array(*[F.coalesce(least_score(score(k), want.least), F.lit(ANY)) for k in slots])
    top = F.array(*[F.coalesce(score(k), F.lit(EMPTY + 1)) for k in slots])
    bounded = written(anchors.join(per, "row").withColumn("least", least).withColumn("most", top).drop("scores"))
    lowest, highest = np.full(leaves, np.inf), np.full(leaves, -np.inf)
    for r in bounded.groupBy("leaf").agg(F.min(F.array_min("least")).alias("least"), F.max(F.array_max("most")).alias("most")).collect():
        lowest[r["leaf"]], highest[r["leaf"]] = float(r["least"]), float(r["most"])
    meets = asking & (high >= lowest[:, None]) & (low <= highest[:, None])
    negatives = best_of(search(bounded, meets, want.negatives, False), want.negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = negatives.join(positives, ["anchor", "slot"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def least_score(positive: Column, hundredths: int) -> Column:
    """The smallest whole number that is at least so many hundredths of a positive's score (exact for any long)."""
    return F.ceil(positive.cast("decimal(24,0)") * hundredths / 100).cast("long")


def op12_dual_tree_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings``; where vec_id is divisible by 7 the label first becomes (label + 1) % 10."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)
