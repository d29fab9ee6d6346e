"""Removal of repeated passages and near-duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sedgework.llm import jaccard_join, suffix_dedup

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}x" for i in range(400)]


def brute_cut(docs: list[tuple[int, str | None]], width: int = 50) -> dict[int, tuple]:
    """Of distinct ids: bytes, removed bytes, runs and the hash of the rest."""
    first: dict[bytes, int] = {}
    raw = {i: (t or "").encode() for i, t in docs}
    for i, b in raw.items():
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def passages(seed: int, n: int = 60) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    shared = [" ".join(rng.choices(WORDS, k=rng.randint(8, 40))) for _ in range(6)]
    docs: list[tuple[int, str | None]] = []
    for i in range(n):
        parts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 60))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared)[rng.randint(0, 9) :])
        docs.append((i * 3, " ".join(parts)))
    return docs + [(1, None), (2, ""), (4, "a" * 3000), (5, "a" * 200), (7, "é" * 80), (8, "x" + "é" * 60), (10, docs[0][1]), (11, docs[0][1])]


def test_repeats_brute_force(spark):
    for seed in (1, 2):
        docs = passages(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
        assert got == brute_cut(docs)


def test_repeats_of_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op2_suffix_dedup(spark, SF).collect()}
    assert got == brute_cut(docs)


def test_repeats_small_batches(spark):
    """Many buckets, batches and groups give what one gives."""
    docs = passages(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    small = suffix_dedup.Settings(bucket_bytes=500, group_bytes=900, batch_bytes=2_000, sample=10)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, small).collect()}
    assert got == brute_cut(docs)


def hot_passages(seed: int) -> list[tuple[int, str | None]]:
    """Every document has some of the passages, with other edges each time: grams of unequal pieces, one of them in all documents."""
    rng = random.Random(seed)
    shared = [" ".join(rng.choices(WORDS, k=14)) for _ in range(8)]
    return [(i, " ".join(w for p in [shared[0], *rng.sample(shared[1:], 3)] for w in [*rng.choices(WORDS, k=9), p[rng.randint(0, 6) : len(p) - rng.randint(0, 6)]])) for i in range(70)]


def test_whole_groups_cover_all():
    rng = random.Random(4)
    for most in (1, 5, 60):
        for sizes in ([10, 300, *[4] * 50], [rng.randint(1, 9) for _ in range(80)], [1], [7], []):
            group = np.repeat(np.arange(len(sizes)), sizes)
            got = list(suffix_dedup.whole_groups(group, most))
            assert [i for lo, hi in got for i in range(lo, hi)] == list(range(len(group)))
            assert all(hi == len(group) or group[hi] != group[hi - 1] for _, hi in got)
            assert all(hi - lo <= most or len(set(group[lo:hi])) == 1 for lo, hi in got)


def test_repeats_in_chunks(spark):
    """Chunks of 5 pieces, and a gram with more than that."""
    docs = hot_passages(6)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, suffix_dedup.Settings(chunk=5)).collect()}
    assert got == brute_cut(docs)


def test_repeats_of_hot_grams(spark):
    """Grams of the sample that occur twice are dealt out window by window, with the same result."""
    docs = hot_passages(7) + [(1000 + i, t) for i, t in passages(8, 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    split = suffix_dedup.Settings(hot_pieces=1, batch_bytes=3_000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, split).collect()}
    assert got == brute_cut(docs)


def test_hot_gram_is_spread():
    """No bucket has all pieces of a gram that every document has, and of a window that all have each batch sends one."""
    docs = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}".encode() * 30 + b" the one passage that all of the documents here have in common " + f"{i:05d}".encode() * 9 for i in range(400)]
    width, none = 50, np.zeros((0, 2), np.uint64)
    rows = suffix_dedup.pieces(docs, width)[4]
    grams, times = np.unique(np.stack(suffix_dedup.leading(rows, width - suffix_dedup.GRAM), 1), axis=0, return_counts=True)
    ids, most = np.arange(400), []
    for hot in (none, grams[times >= 400]):
        got = list(suffix_dedup.blocks_of(ids, ids, docs, none, width, hot, 16))
        counts = {}
        for bucket, blob in got:
            counts[bucket] = counts.get(bucket, 0) + len(suffix_dedup.unpack(blob, suffix_dedup.BLOCK)[4])
        most.append(counts)
    assert len(most[0]) == 1 and len(most[1]) > 12
    hot_counts = [n for b, n in most[1].items() if b > 0]
    assert max(hot_counts) < 0.2 * sum(hot_counts)


def test_repeats_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).count() == 0
    long = " ".join(WORDS[:30])
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long)], "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    got = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, len(long))]


def shingles(text: str | None, k: int = 5) -> frozenset:
    found = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))) if found else frozenset()


def brute_groups(docs: list[tuple[int, str | None]], threshold: float = 0.8) -> tuple[dict, dict]:
    """Smallest id of each id's group, and the number of linked classes."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    classes: dict[frozenset, int] = {}
    for i, s in sets.items():
        if s:
            classes.setdefault(s, i)
            classes[s] = min(classes[s], i)
    links = dict.fromkeys(sets, 0)
    kinds = list(classes)
    for x, a in enumerate(kinds):
        for b in kinds[x + 1 :]:
            if len(a & b) >= threshold * len(a | b) - 1e-9:
                links[classes[a]] += 1
                links[classes[b]] += 1
                p, q = root(classes[a]), root(classes[b])
                parent[max(p, q)] = min(p, q)
    group = {i: root(classes[s]) if s else i for i, s in sets.items()}
    return group, {i: links[classes[s]] if s else 0 for i, s in sets.items()}


def near_copies(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    docs: list[tuple[int, str | None]] = []
    for base in range(25):
        text = rng.choices(WORDS, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 5)):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            docs.append((len(docs) * 7 + base, " ".join(copy)))
    return docs + [(100_001, None), (100_002, ""), (100_003, "..."), (100_004, "one"), (100_005, "One!"), (100_006, "word " * 30_000)]


def test_near_duplicates_brute_force(spark):
    for seed in (1, 2):
        docs = near_copies(seed)
        group, links = brute_groups(docs)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = jaccard_join.near_duplicates(df).collect()
        assert {r.doc_id: r.group_id for r in got} == group
        assert {r.doc_id: r.n_links for r in got} == links


def test_near_duplicates_in_small_blocks(spark):
    docs = near_copies(5)
    docs += [(200_000 + i, " ".join(WORDS[:60]) + f" end{i}") for i in range(40)]
    group, links = brute_groups(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = jaccard_join.near_duplicates(df, jaccard_join.Settings(block=4, verify_block=3)).collect()
    assert {r.doc_id: r.group_id for r in got} == group
    assert {r.doc_id: r.n_links for r in got} == links


def test_near_duplicates_of_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    group, links = brute_groups(docs)
    got = jaccard_join.op10_ngram_jaccard_join(spark, SF).collect()
    assert {r.doc_id: (r.group_id, r.n_links) for r in got} == {i: (group[i], links[i]) for i in group}


def test_one_of_each_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(empty).count() == 0
    text = " ".join(WORDS[:40])
    rows = [(None, text), (3, text), (3, text), (4, text + " more"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("group_id", F.lit("clash"))
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == ["doc_id", "text", "group_id"]
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6]


def test_near_duplicates_of_text_ids(spark):
    """Ids of any type stay as they are; rows equal in id and text leave one."""
    text = "one two three four five six seven eight nine ten"
    rows = [("b", text, 1), ("a", text + " eleven", 2), ("c", "something else entirely here, of its own kind", 3), ("b", text, 4), (None, text, 5), ("9007199254740993", None, 6)]
    df = spark.createDataFrame(rows, "doc_id string, text string, class_id int")
    got = sorted(((r.doc_id, r.class_id, r.group_id) for r in jaccard_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([("b", "b", "a"), ("b", "b", "a"), (None, "b", "a"), ("a", "a", "a"), ("c", "c", "c"), ("9007199254740993",) * 3], key=str)
    kept = jaccard_join.one_of_each(df).collect()
    assert sorted(r.doc_id for r in kept) == ["9007199254740993", "a", "c"]
    big = df.selectExpr("9007199254740993 + cast(class_id AS bigint) AS doc_id", "text")
    assert {r.doc_id for r in jaccard_join.near_duplicates(big).collect()} == {9007199254740993 + k for k in range(1, 7)}
