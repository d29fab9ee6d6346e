"""Capitalised phrases: equal to the patterns that take the character before along; each is looked for once."""

from __future__ import annotations

import random
import re
from collections import Counter

from sedgework import queries
from sedgework.operators import matching as M


def test_patterns_are_applied_once(spark):
    text = queries.QUERIES["noun_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_extract_all", text)) == 2


def test_is_what_the_patterns_find(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["A", "Bc", "d", "-", "&", "_", "7", " ", " ", "\t", "\n", "É", "\U0001f600", "XYZ"]) for _ in range(rng.randrange(40))) for _ in range(600)]
    both = ("(?:^|[^A-Za-z0-9_&-])([A-Z][A-Za-z][A-Za-z&-]*(?:[ \\t]+[A-Z][A-Za-z][A-Za-z&-]*){1,3})", "(?:^|[^A-Za-z0-9_])([A-Z][A-Z0-9]{1,5})")
    expected = Counter((k, p.lower()) for k, t in enumerate(texts) for x in both for p in re.findall(x, t))
    got = M.noun_phrases(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect()
    assert {(r.k, r.phrase): r.n for r in got} == expected and len(expected) > 500
