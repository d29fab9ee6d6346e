"""Hard negatives against brute force on tables with and without structure, odd rows, both kinds of sums."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgework.llm import dual_tree as dt

SF = "/root/testdata/sf0.001"


def brute(rows: list[tuple], scale: int = 256) -> list[tuple]:
    """(vec_id, embedding, label) rows by the contract, with exact whole numbers."""
    fine = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, [math.floor(scale * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for n, (i, v, label) in enumerate(fine):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, m) for m, (j, w, _) in enumerate(fine) if m != n)
        for s, j, _ in [x for x in scored if fine[x[2]][2] == label][:5]:
            bounds = [(-t, k) for t, k, m in scored if fine[m][2] != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, rank, k, -s, t) for rank, (t, k) in enumerate(bounds, 1)]
    return out


def run(spark, rows: list[tuple], settings: dt.Settings | None = None, kind: str = "float") -> list[tuple]:
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return [tuple(r) for r in dt.hard_negatives(df.withColumn("label", label).withColumn("rank", F.lit("x")), F.col("vec_id") % 100 == 0, settings).collect()]


SMALL = dt.Settings(block=0.1, block_least=60, chunk=3, node=8, leaves=24)


def table(kind: str, n: int = 900) -> list[tuple]:
    rng = np.random.default_rng(len(kind))
    if kind == "flat":
        x = rng.normal(size=(n, 16))
    elif kind == "clusters":
        x = rng.normal(size=(12, 16))[rng.integers(0, 12, n)] * 3 + rng.normal(size=(n, 16)) * 0.3
    elif kind == "equal":  # a third of all rows have one vector, so nearly all scores tie
        x = np.where(rng.random((n, 1)) < 0.4, np.ones((1, 4)), rng.integers(-2, 3, (n, 4)))
    else:
        x = rng.normal(size=(n, 3)) * 1e6  # sums beyond double precision
    x = x.astype(np.float32)
    ids = rng.permutation(n * 20)[:n]
    ids[:40] = np.arange(40) * 100
    return [(int(i), [float(c) for c in v], int(k)) for i, v, k in zip(ids, x, rng.integers(0, 10, n), strict=True)]


@pytest.mark.parametrize("kind", ["flat", "clusters", "equal", "large numbers"])
@pytest.mark.parametrize("settings", [None, SMALL])
def test_is_brute_force(spark, kind, settings):
    rows = table(kind)
    want = brute(rows)
    assert Counter(run(spark, rows, settings)) == Counter(want)
    assert len(want) > 100


def test_odd_rows(spark):
    """Null, empty, short, zero and non-finite vectors, null ids and labels, repeated rows and ids, doubles."""
    rows = table("flat", 150)
    v = rows[0][1]
    rows += [(None, v, 1), (100, None, 1), (200, v, None), (300, [None, *v[1:]], 2), (400, [math.nan, *v[1:]], 2), (500, [math.inf, *v[1:]], 2), (600, [], 3), (700, v[:5], 4), (800, [0.0] * 16, 4)]
    rows += [(900, v, 5), (900, v, 5), (901, v, 6), (901, v, 6), (902, v, 5)]
    assert Counter(run(spark, rows, kind="double")) == Counter(brute(rows))
    assert Counter(run(spark, rows, SMALL, "double")) == Counter(brute(rows))


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, None, 1)]) == []
    assert run(spark, [(100, [1.0], 1)]) == []
    assert run(spark, [(100, [1.0], 1), (101, [1.0], 1), (102, [0.9], 2)]) == [(100, 101, 1, 102, 65536, 58880)]


def test_structure_is_pruned(spark):
    """In well-parted data most pairs of nodes are never scored."""
    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(32) * 4000, 40, 0) + rng.normal(size=(1280, 32)) * 20
    seen = []

    class Counted(dt.Search):
        def score_pair(self, here, there):
            seen.append(len(here) * len(there))
            super().score_pair(here, there)

    side = {"x": x.round(), "label": np.arange(1280) % 10, "row": np.arange(1280), "id": np.arange(1280)}
    slots = {"least": np.full((1280, 1), dt.EMPTY + 1), "most": np.full((1280, 1), dt.ANY)}
    found = Counted(side | slots, side, 2, True, 8, True)
    found.run()
    assert sum(seen) < 0.1 * 1280**2
    s = x.round() @ x.round().T
    np.fill_diagonal(s, -np.inf)
    s[(np.arange(1280)[:, None] - np.arange(1280)) % 10 != 0] = -np.inf
    assert (found.score[:, 0] == -np.sort(-s, 1)[:, :2]).all()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = dt.op12_dual_tree_negatives(spark, SF)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows))
