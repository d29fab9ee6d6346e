"""Rewritten lines, marked metrics, labels and marked bullets: golden cases, each in one run."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgework.functions import rewrites as R
from sedgework.operators import bullets as B

CLEAN = {
    "Rewritten: - **Led** the migration": "Led the migration", "*Foo.*": "Foo.", "**All of it**": "All of it", "1. - • - **Led** stuff.": "Led stuff.", "- 3.5x revenue growth": "3.5x revenue growth", "Developed and **implemented** it": "Developed and **implemented** it",
    "Here are the rewritten bullets:": "", "\"Quoted\"": "Quoted", "“Nice”": "Nice", "": "", "_x_": "x", "2) Two": "Two", "plain": "plain", "- Rules:": "", "Original bullets:": "",
}
METRICS = {
    "cut cost by 28% for 3 engineers": "cut cost by [28%] for [3 engineers]", "$1.2M ARR and 40x": "[$1.2M ARR] and [40x]", "a 12-person team of 10k+ users": "a [12-person team] of [10k+ users]", "version 3.5": "version 3.5", "done [5%] now 6%": "done [5%] now [6%]", "": "",
}


def test_clean_lines(spark):
    df = spark.createDataFrame([(t,) for t in CLEAN] + [(None,)], "t string")
    assert {r.t: r.c for r in df.select("t", R.clean_line(F.col("t")).alias("c")).collect()} == CLEAN | {None: ""}


def test_bold_metrics(spark):
    mark = lambda s: s.replace("[", R.OPEN).replace("]", R.CLOSE)
    df = spark.createDataFrame([(k, mark(k)) for k in METRICS], "k string, t string")
    assert {r.k: r.b for r in df.select("k", R.bold_metrics(F.col("t")).alias("b")).collect()} == {k: mark(v) for k, v in METRICS.items()}


def test_labels_and_reverts(spark):
    df = spark.createDataFrame([("Award · Best Paper",), ("x" * 29 + " · y",), (" · y",), ("plain",)], "t string")
    assert [r.s and tuple(r.s) for r in df.select(R.split_label(F.col("t")).alias("s")).collect()] == [("Award", "Best Paper"), None, None, None]
    rows = [(1, ["a 5"], ["b 5"], [], []), (2, ["a 5"], ["b"], ["5"], []), (3, ["a"], [], ["1"], [])]
    df = spark.createDataFrame(rows, "k int, o array<string>, r array<string>, d array<string>, a array<string>")
    got = {r.k: (r.x["lines"], r.x["reverted"]) for r in df.select("k", R.kept_rewrite(*map(F.col, "orda")).alias("x")).collect()}
    assert got == {1: (["b 5"], False), 2: (["a 5"], True), 3: ([], False)}


def test_marked_bullets(spark):
    docs = {"a": ["• one", "•", "two", "plain", "3. three", "•", "•", "four", "- ", "•"], "b": ["•", "•", "•", "x"], "c": [None, "• ?"]}
    df = spark.createDataFrame([(k, i, t) for k, v in docs.items() for i, t in enumerate(v)], "k string, ord int, line string")
    got = [(r.k, r.bullet) for r in B.marked_bullets(df, ["k"]).orderBy("k", "ord").collect()]
    assert got == [("a", "one"), ("a", "two"), ("a", "three"), ("b", "x")]
