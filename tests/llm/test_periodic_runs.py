"""Runs of words against brute force, planted runs, odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sedgework.llm import periodic_runs as pr


def brute(w: list, want: pr.Settings) -> list[tuple[int, int, int]]:
    n, found = len(w), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(want.length, want.exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def texts(rng: random.Random, n: int) -> list[list[bytes]]:
    out = []
    for _ in range(n):
        w: list[int] = []
        while len(w) < rng.choice((10, 40, 90, 160)):
            kind = rng.random()
            if kind < 0.4:
                w += [rng.randrange(rng.choice((2, 3, 50))) for _ in range(rng.randrange(1, 20))]
            elif kind < 0.8:
                unit = [rng.randrange(rng.choice((2, 4, 30))) for _ in range(rng.randrange(1, 12))]
                w += (unit * 12)[: rng.randrange(1, 5 * len(unit) + 20)]
            elif w:
                a = rng.randrange(len(w))
                w += w[a : a + rng.randrange(1, 60)]
        out.append([b"w%d" % x for x in w])
    return out


@pytest.mark.parametrize("want", [pr.Settings(), pr.Settings(6, 2), pr.Settings(2, 2), pr.Settings(9, 3), pr.Settings(12, 4)])
def test_runs_are_those_of_brute_force(want):
    rng = random.Random(10 * want.length + want.exponent)
    some = texts(rng, 250)
    found = pr.runs_of(some, want)
    assert found == [brute(w, want) for w in some]
    assert sum(map(len, found)) > 100
    for w in some[:100]:  # also without the choice of stretches
        assert pr.maximal_runs([int(x[1:]) for x in w], want) == brute(w, want)


def test_factors_are_longest_and_earlier():
    rng = random.Random(5)
    for w in texts(rng, 60):
        at = 0
        for start, size, source in pr.factors([int(x[1:]) for x in w]):
            assert start == at
            longest = max((next((k for k in range(len(w) - start) if w[s + k] != w[start + k]), len(w) - start) for s in range(start)), default=0)
            assert size == max(1, longest)
            assert source < start and (source < 0 or w[source : source + size] == w[start : start + size])
            at += size
        assert at == len(w)


def expected(doc_id, text) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w, pr.Settings())
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_is_brute_force_on_a_table(spark, tmp_path):
    """All documents of the smallest table, and odd rows: null, empty, white space only, repeated, a null id, other blanks."""
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' WHERE length(text) < 9000").fetchall()
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \t\n\x0b\x0c\r "), (None, "a b " * 30), (7, "x y\x1cz " * 40), (7, "x y\x1cz " * 40), *[(2 * 10**6 + i, "tick tock " * 13 + "end " * k) for k in range(30, 34) for i in range(k, k + 10)]]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("other")).write.parquet(f"{tmp_path}/documents.parquet")
    got = pr.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(expected(*r)) for r in rows)
    assert got.where("n_runs > 0").count() > 20


def test_operator_gives_runs_and_text(spark):
    docs = spark.createDataFrame([(1, "lead " + "a b c " * 10 + "tail"), (2, "nothing here")], "id int, body string")
    got = {r.id: r for r in pr.collapse_runs(docs, "body").collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 30, 3)] and got[1].collapsed == "lead a b c tail" and got[1].words == 32
    assert got[2].runs == [] and got[2].collapsed == got[2].body
    assert pr.collapse_runs(docs.limit(0), "body").count() == 0


def test_a_long_periodic_text_takes_linear_time(spark):
    text = " ".join(f"w{i % 997}" for i in range(100_000)) + " z" * 100_000
    [r] = pr.collapse_runs(spark.createDataFrame([(text,)], "text string")).collect()
    assert [tuple(x) for x in r.runs] == [(0, 100_000, 997), (100_000, 100_000, 1)]
