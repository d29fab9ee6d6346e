"""Packing, nearest neighbours, fingerprints, segmentations, tool calls: brute force and round trips."""

from __future__ import annotations

import hashlib
import json
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgework.llm import hash_forest, lz_fingerprint, packing, sampled_pieces, tool_calls
from sedgework.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def placed_whole(rows: list, docs: dict, capacity: int) -> int:
    """Check that pieces are whole and gapless; the number of sequences."""
    tokens = packing.Tokens(packing.vocabulary())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids = tokens.whole(text or "") + b"\0\0\0\0"
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
            assert r.length == capacity or 4 * at == len(ids)
        assert 4 * at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_the_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op7_best_fit_packing"](spark, SF).collect()
    sequences = placed_whole(rows, docs, 2048)
    assert sequences <= math.ceil(sum(r.length for r in rows) / 2048) * 1.02 + 1


def test_packing_program_against_best_fit():
    """Every piece is placed once; never more sequences than plain best fit, fewer where lengths combine badly."""
    rng = np.random.default_rng(4)
    lengths = {"any": rng.integers(1, 2049, 3000), "six": rng.choice([300, 451, 683, 700, 911, 1111], 20_000), "thirds": rng.integers(650, 720, 2000), "repeated": np.repeat([1025, 513, 510], 50), "one": np.array([5]), "none": np.zeros(0, int)}
    for name, found in lengths.items():
        counts = np.bincount(found, minlength=2049)
        rows = packing.plan(counts, packing.Settings())
        placed, held = np.zeros(2049, np.int64), defaultdict(list)
        for length, first, past, each, sequence, base in rows:
            assert first == placed[length] and (past - first) % each == 0
            placed[length] = past
            for k in range((past - first) // each):
                held[sequence + k] += [(base + i * length, length) for i in range(each)]
        assert (placed == counts).all()
        for pieces in held.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
        plain = sum(n for _, n in packing.best_fit(counts, 2048))
        assert len(held) <= plain - (plain // 100 if name in ("six", "thirds") else 0), name


def test_packing_odd_rows(spark):
    docs = {1: None, 2: "", 3: "word " * 9000, 4: "İstanbul ﬁne <|endoftext|> 漢字", 5: "It's 12345 o'clock\n\n", 6: "a" * 5000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("length", F.lit("clash"))
    placed_whole(packing.pack(df, packing.vocabulary()).collect(), docs, 2048)
    assert packing.pack(df.limit(0), packing.vocabulary()).count() == 0
    twice = packing.pack(df.unionByName(df), packing.vocabulary())
    assert twice.count() == 2 * packing.pack(df, packing.vocabulary()).count()


def neighbours(spark, sf_dir: str) -> tuple[float, int]:
    """Recall of the query against brute force, and its number of queries; checks ranks, ids and scores."""
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    got = defaultdict(list)
    for r in QUERIES["op6_hash_prefix_forest"](spark, sf_dir).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = wanted = 0
    for i, v in rows:
        if i % 20:
            assert i not in got
            continue
        score = x @ v
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != i][:20]
        mine = sorted(got[i])
        assert [m[0] for m in mine] == list(range(1, 21)) and i not in {m[1] for m in mine}
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        assert all(abs(s - float(x[np.flatnonzero(ids == j)[0]] @ v)) < 1e-9 for _, j, s in mine)
        hits += len({int(ids[k]) for k in order} & {m[1] for m in mine})
        wanted += 20
    return hits / wanted, len(got)


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.9), ("sf0.1", 0.9)])
def test_nearest_recall(spark, sf, least):
    recall, queries = neighbours(spark, f"/root/testdata/{sf}")
    assert queries and recall >= least


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, None]), (7, [1.0, 1.0]), (None, [1.0, 2.0]), (7, [1.0, 1.0]), (7, [3.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("key", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in hash_forest.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    # rows of one id count each, and [3.0] is [3.0, 0.0]
    assert got == [(0, 1, 7, 3.0), (0, 2, 1, 1.0), (0, 3, 7, 1.0), (0, 4, 7, 1.0), (0, 5, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 7, 1.0), (20, 3, 7, 1.0), (20, 4, 0, 0.0), (20, 5, 7, 0.0)]
    assert hash_forest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_of_hot_vectors(spark):
    """Exactly right where a third of the rows have one vector and cells are small, split and met by many queries."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[::3] = x[0]
    x[1::9] = x[1] + rng.normal(0, 1e-3, (100, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    settings = hash_forest.Settings(cell_rows=40, cell_queries=5, reach=40.0, sample_rows=400, neighbours=7)
    got = defaultdict(list)
    for r in hash_forest.nearest(df, F.col("vec_id") % 10 == 0, settings).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    y, hits = x.astype(np.float64), 0
    for i in range(0, 900, 10):
        score = (y * y[i]).sum(1)
        order = [int(k) for k in np.lexsort((np.arange(900), -score)) if k != i][:7]
        assert len(got[i]) == 7
        hits += len(set(order) & set(got[i]))
    assert hits >= 0.95 * 7 * 90


def test_fingerprints_of_the_tables(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op9_lz_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    prints = defaultdict(set)
    for (i, text), (j, nxt) in zip(docs, [*docs[1:], docs[0]], strict=True):
        n = len(text) // 2
        edited = text[: len(text) - n] + nxt[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints[text].add(r.fingerprint)
        alike = np.mean([r.fingerprint[k : k + 4] == got[j].fingerprint[k : k + 4] for k in range(0, 256, 4)])
        assert abs(alike - r.near_next) < 1e-12 and 0 <= r.near_edited <= 1
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in got.values() if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long])


def test_fingerprint_phrases():
    text = "abababab abc abc"
    ends, _ = lz_fingerprint.parse_both(text, None)
    phrases = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    seen: set[str] = set()
    for p in phrases[:-1]:
        assert p not in seen and (len(p) == 1 or p[:-1] in seen)
        seen.add(p)
    assert "".join(phrases) == text


def test_fingerprints_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "yz"), (9, "w" * 100_000)], "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    got = lz_fingerprint.edit_fingerprints(df).collect()
    assert len(got) == 6
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert lz_fingerprint.edit_fingerprints(df.limit(0)).count() == 0


def test_segmentations(spark):
    got = QUERIES["op3_sampled_pieces"](spark, SF).collect()
    assert got and all(r.restored for r in got)
    rows = [(1, "Hello  world ▁ x\0y"), (2, None), (3, ""), (4, "naïve 漢字 🎉"), (4, "naïve 漢字 🎉"), (5, "ab " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = sampled_pieces.sample_segmentations(df, ["doc_id"], sampled_pieces.vocabulary()).collect()
    assert all(r.restored for r in out)
    each = defaultdict(list)
    for r in out:
        each[r.doc_id].append(tuple(r.ids))
    assert each[2] == each[3] == [()]
    assert len(set(each[1])) == 3 and len(each[4]) == 6 and len(set(each[4])) == 3
    assert sampled_pieces.sample_segmentations(df.limit(0), ["doc_id"], sampled_pieces.vocabulary()).count() == 0


def test_segmentations_of_all_documents(spark):
    """Every document has its own encoding and at least one sample, and all give its whole text back."""
    docs = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    got = QUERIES["op3_sampled_pieces"](spark, SF).collect()
    assert all(r.restored for r in got)
    for k in (0, 1):
        assert sorted(r.doc_id for r in got if r["sample"] == k) == sorted(docs)


def test_decoding(spark):
    rows = [(1, "Hello  world ▁ x\0y"), (2, None), (3, ""), (4, " naïve 漢字 🎉\n\t"), (5, "ab " * 3000)]
    df, path = spark.createDataFrame(rows, "doc_id long, text string"), sampled_pieces.vocabulary()
    for ids in (sampled_pieces.encode(df, path), sampled_pieces.sample_segmentations(df, ["doc_id"], path)):
        got = sampled_pieces.decode(ids.drop("text"), path).collect()
        assert {(r.doc_id, r.text) for r in got} == {(i, t or "") for i, t in rows}


def test_sampling_follows_the_lattice():
    """First draws of many seeds are as frequent as the segmentations are likely."""
    lat = sampled_pieces.lattice(sampled_pieces.vocabulary(), sampled_pieces.Settings(samples=2, temperature=1.0))
    seen: dict[tuple, list[float]] = defaultdict(list)
    for seed in range(3000):
        ids, log_p, _ = lat.sample("the", seed, 1)[0]
        seen[tuple(ids)].append(log_p)
    mass = {k: math.exp(v[0]) for k, v in seen.items()}
    whole = sum(math.exp(lp) for ids, lp, _ in lat.sample("the", 1, 100))
    assert abs(whole - 1) < 1e-6
    for k, v in seen.items():
        assert abs(len(v) / 3000 - mass[k]) < 0.05


def test_draws_without_replacement():
    """Second and third draws of many seeds follow the segmentations that are left; inclusion scores are unbiased."""
    lat = sampled_pieces.Lattice(sampled_pieces.vocabulary(), sampled_pieces.Settings())
    mass = {tuple(ids): math.exp(p) for ids, p, _ in lat.sample("the", 1, 100)}
    assert len(mass) == 8 and abs(sum(mass.values()) - 1) < 1e-9
    n = 6000
    of, nth, log_p, inclusion, size, ids = lat.draw(["the"] * n, list(range(n)), 3)
    ways = [tuple(x.tolist()) for x in np.split(ids, np.cumsum(size)[:-1])]
    assert len(ways) == 3 * n and all(len(set(ways[i : i + 3])) == 3 for i in range(0, 3 * n, 3))
    assert abs(np.exp(log_p - inclusion).sum() / n - 1) < 0.01
    for draw in (1, 2, 3):
        for way in mass:
            before = [x for x in np.ndindex(*[8] * (draw - 1)) if len(set(x)) == draw - 1]
            keys = list(mass)
            want = 0.0
            for x in before:
                if way not in (taken := [keys[i] for i in x]):
                    p = mass[way] / (1 - sum(mass[t] for t in taken))
                    for j, t in enumerate(taken):
                        p *= mass[t] / (1 - sum(mass[u] for u in taken[:j]))
                    want += p
            got = sum(w == way for w, d in zip(ways, nth.tolist(), strict=True) if d == draw) / n
            assert abs(got - want) < 0.03


def test_draws_of_odd_texts():
    """Texts of few segmentations, of none but one, of runs of spaces and of long words are whole, alone as in a batch."""
    texts = ["", " ", "a", "1", "漢字" * 50, "  two  runs ", "▁\0 x", "b" * 200, "the cat\nsat. " * 30]
    lat = sampled_pieces.Lattice(sampled_pieces.vocabulary(), sampled_pieces.Settings())
    of, _, log_p, inclusion, size, ids = lat.draw(texts, list(range(len(texts))), 3)
    assert lat.decode_all(ids, size) == [texts[i] for i in of]
    assert np.bincount(of)[:4].tolist()[0] == 1 and np.bincount(of)[2] == 2 and np.bincount(of)[3] == 1
    ways = np.split(ids, np.cumsum(size)[:-1])
    for i, t in enumerate(texts):
        mine = np.flatnonzero(of == i)
        assert len({tuple(ways[m].tolist()) for m in mine}) == len(mine)
        alone = sampled_pieces.Lattice(sampled_pieces.vocabulary(), sampled_pieces.Settings()).sample(t, i, 3)
        assert [(list(map(int, x)), p, q) for x, p, q in alone] == [(ways[m].tolist(), log_p[m], inclusion[m]) for m in mine]


def test_draws_cost_little_noise(monkeypatch):
    """A draw hashes about once for each piece it takes, not for each edge of the lattice on its way."""
    text = " ".join(f"segmentation{chr(97 + i % 26)} of several longer words" for i in range(60))
    lat = sampled_pieces.Lattice(sampled_pieces.vocabulary(), sampled_pieces.Settings())
    hashed, mix = [], sampled_pieces.mix64
    monkeypatch.setattr(sampled_pieces, "mix64", lambda x: hashed.append(np.size(x)) or mix(x))
    drawn = lat.sample(text, 7, 3)
    assert sum(hashed) < 2 * sum(len(ids) for ids, _, _ in drawn)


def linked(spark, calls: list, results: list) -> list:
    df = spark.createDataFrame(calls, "call_id string, name string, arguments string, after array<string>").withColumn("step", F.lit("clash")).withColumn("result", F.lit(0))
    schemas = spark.createDataFrame(tool_calls.REPLY_SCHEMAS + [("all", "o", "object", True, None), ("all", "l", "array", False, None), ("all", "b", "boolean", False, None), ("all", "x", "number", False, 5)], tool_calls.SCHEMA)
    return tool_calls.link_tool_calls(df, spark.createDataFrame(results, "call_id string, content string"), schemas).collect()


def test_tool_calls(spark):
    calls = [
        ("a", "reply", '{"turn": 1, "prompt": "hi"}', None), ("b", "reply", '{"prompt": "", "turn": "1"}', ["a"]), ("c", "reply", '{"prompt":"p","turn":2,"zz":{"b":1,"a":[ 2 ]}}', ["b"]), ("d", "nope", "{}", ["c", None]),
        ("e", "configure", '{"prompt":"p"}', ["f"]), ("f", "configure", '{"prompt":"p"}', ["e"]), ("h", "configure", '{"prompt":"p"}', ["e"]), (None, "reply", None, None), ("a", "reply", '{"turn": 1, "prompt": "hi"}', None), ("g", "configure", '{"prompt":"q"}', ["unknown"]),
        ("i", "all", '{"o":{},"l":[],"b":true,"x":4.5}', ["d", "b", "g"]), ("j", "all", '{"o":[],"l":1,"b":"x","x":6}', ["i", "e"]), ("k", "configure", "[1]", ["i", "a"]), ("l", "configure", '{"prompt": "long %s"}' % ("x" * 50_000), ["k"]),
    ]
    got = linked(spark, calls, [("a", "two"), ("a", "one"), ("zz", "x"), (None, "y")])
    assert len(got) == len(calls)
    of = {r.call_id: r for r in got}
    assert [of[c].step for c in "abcdefghijkl"] == [0, 1, 2, 3, None, None, 0, None, 4, None, 5, 6]
    assert {of[c].root for c in "abcdikl"} == {"a"} and of["g"].root == "g" and of["a"].result == "one" and of["b"].result is None
    assert [of[c].errors for c in "abcdijkl"] == [[], ["prompt", "turn"], ["zz"], ["?"], [], ["b", "l", "o", "x"], ["?"], ["prompt"]]
    assert '"zz":{"a":[2],"b":1}' in of["c"].json and '"arguments":{"prompt":"hi","turn":1}' in of["a"].json
    for r in got:
        parsed = json.loads(r.json)
        assert list(parsed) == sorted(parsed) and " " not in r.json.replace("long ", "")
    assert linked(spark, calls[:1], [])[0].result is None


def test_tool_call_order_against_brute_force(spark):
    """Chains, joins and cycles of a random graph of waits."""
    rng = random.Random(5)
    names = [f"n{k:03d}" for k in range(120)]
    after = {n: [] for n in names}
    for k in range(1, 60):
        after[names[k]] = [names[k - 1]]  # one long chain
    for k in range(60, 110):
        after[names[k]] = rng.sample(names[:k], rng.choice([0, 1, 1, 2, 3]))
    for k in range(110, 120):
        after[names[k]] = [names[110 + (k - 109) % 8]] if k < 118 else [names[k - 5], names[3]]

    def step(n: str, seen: tuple = ()):
        if n in seen:
            return None
        below = [step(m, (*seen, n)) for m in after[n]]
        return None if None in below else 1 + max(below, default=-1)

    rows = [(n, a) for n, a in after.items()]
    got = {r.call_id: r.step for r in tool_calls.steps(spark.createDataFrame(rows, "call_id string, after array<string>")).collect()}
    assert got == {n: step(n) for n in names}


def test_tool_calls_oracle(spark):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import oracle

    assert oracle.difference(QUERIES["op8_tool_call_linking"](spark, SF), oracle.connection(SF), SQL["op8_tool_call_linking"]) == ""
