"""Mentions by a dictionary table: against a scan of every place, against the literal dictionary, guards, a large dictionary."""

from __future__ import annotations

import random
import re
from collections import Counter

from sedgework.functions import values as V
from sedgework.operators import dictionary as D
from sedgework.operators import skills as K
from sedgework.plans.skill_queries import SKILLS

EDGE = re.compile(V.ALIAS_EDGE)
NAMES = "alias string, skill string, label string"


def scan(text: str, index: dict) -> list:
    """Left to right, the longest alias (in tokens, then characters) between edges."""
    low, out, i = text.lower(), [], 0
    size = lambda a: len(re.findall(D.TOKEN, a))
    while i < len(low):
        if i == 0 or EDGE.match(low[i - 1]):
            hits = [a for a in index if low.startswith(a, i) and (i + len(a) == len(low) or EDGE.match(low[i + len(a)]))]
            if hits:
                best = max(hits, key=lambda a: (size(a), len(a)))
                out.append(index[best])
                i += len(best)
                continue
        i += 1
    return out


def test_is_a_scan_of_every_place(spark):
    rng = random.Random(3)
    words = ["a", "b", "ab", "c++", "a.b", ".net", "ci/cd", "node.js", "machine", "learning", "of the", "a b", "b a", "a b c", "c"]
    index = {w: f"s{k % 11}" for k, w in enumerate(words)} | {f"{a} {b}": f"p{a}{b}" for a in ("machine", "a") for b in ("learning", "b", ".net")}
    table = spark.createDataFrame([(a.upper(), s, None) for a, s in index.items()], NAMES)
    texts = [(k, "".join(rng.choice(words) + rng.choice((" ", "  ", ", ", "/", ".", "\n", "")) for _ in range(rng.randrange(0, 40)))) for k in range(200)] + [(999, None), (998, "")]
    got = Counter({(r.k, r.skill): r.n for r in D.mentions(spark.createDataFrame(texts, "k int, t string"), "k", "t", table).collect()})
    assert got == Counter((k, s) for k, t in texts if t for s in scan(t, index)) and len(got) > 500


def test_agrees_with_a_literal_dictionary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    table = spark.createDataFrame([(a, i, label) for i, label, aliases in SKILLS for a in aliases], NAMES)
    own, other = D.mentions(docs, "doc_id", "text", table), K.mentions(docs, "doc_id", "text", SKILLS)
    rows = lambda d: Counter(map(tuple, d.select("doc_id", "skill", "n", "label").collect()))
    assert rows(own) == rows(other)


def test_doubtful_matches(spark):
    table = spark.createDataFrame([("r", "r", "R"), ("s", "s", "S"), ("python", "python", None), ("team building", "team", "Team building"), ("go", "go", "Go")], NAMES)
    texts = {1: "we use R/S and Python", 2: "an R/X device", 3: "X/R too", 4: "go, r", 5: "team building the best", 6: "team building skills, python", 7: "Python first, then R, then Python"}
    got = D.terms(spark.createDataFrame(list(texts.items()), "k int, t string"), "k", "t", table).collect()
    by = {k: sorted((r.at, r.skill) for r in got if r.k == k) for k in texts}
    assert {k: [s for _, s in v] for k, v in by.items()} == {1: ["r", "s", "python"], 2: [], 3: [], 4: ["go", "r"], 5: [], 6: ["team", "python"], 7: ["python", "r"]}


def test_thousands_of_aliases_and_none(spark):
    table = spark.range(5000).selectExpr("concat('term', id) AS alias", "concat('s', id % 7) AS skill", "CAST(NULL AS STRING) AS label")
    df = spark.createDataFrame([(1, "term17, term4999 and term5000; Term17")], "k int, t string")
    assert {(r.skill, r.n, r.label) for r in D.mentions(df, "k", "t", table).collect()} == {("s3", 2, "s3"), ("s1", 1, "s1")}
    assert D.mentions(df, "k", "t", table.limit(0)).count() == 0


def test_rows_of_one_key_are_texts_of_their_own(spark):
    table = spark.createDataFrame([("machine learning", "ml", None), ("machine", "m", None)], NAMES)
    df = spark.createDataFrame([(1, "machine learning"), (1, "machine"), (None, "machine")], "k int, t string")
    assert sorted((r.k or 0, r.skill, r.n) for r in D.mentions(df, "k", "t", table).collect()) == [(0, "m", 1), (1, "m", 1), (1, "ml", 1)]
