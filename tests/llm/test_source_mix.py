"""Targets against the loop that the contract describes, exact quotas, disjoint shards, equal reruns, odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgework.llm import source_mix as sm

SF = "/root/testdata/sf0.001"


def shared(sizes: dict, most: int = 3) -> dict:
    """Share by weight, stop at the limit, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        got = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if got[s] > most * sizes[s] + 1e-9}
        if not over:
            return got | {s: most * sizes[s] for s in full}
        full |= over


def checked(rows: list[tuple], got: list) -> None:
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
    goal = shared(sizes)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, size(t)) for d, s, t in rows)
    taken: dict = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.5 + 1e-6 for s in sizes)


def test_query_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sm.op13_source_mix(spark, SF)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    first = got.collect()
    checked([tuple(r) for r in docs.select("doc_id", "source", "text").collect()], first)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert Counter(first) == Counter(sm.op13_source_mix(spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


ODD = [
    *[(i, "big", "w " * 700) for i in range(40)], *[(100 + i, "big", f"only{i}") for i in range(20)], (200, "tiny", "a b c"), (201, "é", "x " * 9000), (202, None, "n n n"), (203, None, None), (None, "big", "no id " * 5),
    (204, "empty", ""), (205, "empty", None), (206, "dup", "same words here"), (206, "dup", "same words here"), (206, "dup", "same words here"), (207, "Z", "\x1c \x0b \x0c"), (208, "", "blank source"),
]


def test_odd_rows(spark, tmp_path):
    """Null text, id and source, empty texts, repeated rows, a hot source, sources at their limit, other columns."""
    spark.createDataFrame(ODD, "doc_id long, source string, text string").withColumn("taken", F.lit(1)).withColumn("target", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    checked(ODD, sm.op13_source_mix(spark, str(tmp_path)).collect())


def test_empty_tables(spark, tmp_path):
    for n, rows in enumerate(([], [(1, "a", None), (2, None, " ")])):
        spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        assert [(r.target, r.taken) for r in sm.op13_source_mix(spark, f"{tmp_path}/{n}").collect()] == [(0.0, 0)] * len(rows)


def test_shards_are_disjoint_and_exact(spark):
    """Every drawn block is in one shard, a pass takes a block once at most, shards are full, positions gapless."""
    want = sm.Settings(block_words=7, shard_blocks=50, chunk=4)
    docs = spark.createDataFrame(ODD, "doc_id long, source string, text string")
    rows, sources, mix = sm.mixed(docs, want)
    got = mix.collect()
    assert max(Counter((r.key, r["copy"], r.piece, r["pass"]) for r in got).values()) == 1
    per = Counter(r.shard for r in got)
    total, shards = len(got), -(-len(got) // 50)
    assert per == {s: total * (s + 1) // shards - total * s // shards for s in range(shards)} and shards > 8
    assert all(sorted(r.position for r in got if r.shard == s) == list(range(per[s])) for s in per)
    drawn = sm.drawn(rows, sources, want).collect()
    assert Counter((r.key, r["copy"], r.piece, r["pass"], r.words) for r in got) == Counter((r.key, r["copy"], r.piece, r["pass"], r.words) for r in drawn)
    for nth in {r.nth for r in drawn}:
        assert sorted(r.rank for r in drawn if r.nth == nth) == list(range(sum(r.nth == nth for r in drawn)))
    words = {(r.shard, r.position): r.text for r in sm.texts(docs, mix).collect()}
    by_key = {r.key: r.text for r in docs.select(F.xxhash64("doc_id", "source", "text").alias("key"), "text").collect()}
    assert len(words) == total
    for r in got:
        assert words[r.shard, r.position] == " ".join(re.findall(sm.WORD, by_key[r.key])[r.start : r.start + r.words])


@pytest.mark.parametrize(("good", "bad", "sample"), [(5, 7, 6), (3, 40, 20), (12, 4, 9), (1, 1, 1)])
def test_hypergeometric_draws_have_their_probabilities(good, bad, sample):
    n = 20_000
    got = Counter(sm.hypergeometric((k + 0.5) / n, good, bad, sample) for k in range(n))
    for x in range(max(0, sample - bad), min(good, sample) + 1):
        p = math.comb(good, x) * math.comb(bad, sample - x) / math.comb(good + bad, sample)
        assert abs(got[x] / n - p) < 2e-4
    big = sm.hypergeometric(0.5, 4 * 10**10, 6 * 10**10, 10**10)
    assert abs(big - 4 * 10**9) < 5


def test_the_tree_is_a_shuffle_of_all_blocks():
    """Mean and variance of a shard's blocks of a source are those of a draw from all blocks; parts agree with the whole."""
    counts = np.array([300, 500, 200])
    draws = np.array([list(sm.dealt(counts, 1000, 10, 3, 4, seed))[0][2] for seed in range(1500)])
    assert np.allclose(draws.mean(0), counts / 10, atol=0.4)
    assert np.allclose(draws.var(0), 100 * counts / 1000 * (1 - counts / 1000) * 900 / 999, rtol=0.12)
    whole = {s: (f.tolist(), n.tolist()) for s, f, n in sm.dealt(counts, 1000, 10, 0, 10, 1)}
    assert {s: (f.tolist(), n.tolist()) for lo in (0, 5) for s, f, n in sm.dealt(counts, 1000, 10, lo, lo + 5, 1)} == whole
    assert np.sum([n for _, n in whole.values()], 0).tolist() == counts.tolist()
