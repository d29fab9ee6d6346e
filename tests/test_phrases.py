"""Phrases of lines: against a reading word by word; a line is read in a few passes."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from sedgework import queries
from sedgework.functions import values as V
from sedgework.operators import boards as N


def by_words(line: str) -> str | None:
    bare = line.strip(" ")
    for pattern in ("^[0-9]+[.)]\\s*", "^[•*-]\\s*", "^[*]+", "^[\"'`“‘]"):
        bare = re.sub(pattern, "", bare, flags=re.ASCII)
    last = None
    for t in re.split(r"\s+", bare.lower(), flags=re.ASCII)[1:]:
        plain = re.sub("[^a-z'-]", "", t)
        if t in V.PHRASE_STOPS:
            last = None
        elif not re.match("[$]?[0-9]", t) and len(plain) >= 3:
            if last:
                return f"{last} {plain}"
            last = plain
    return None


def test_is_a_reading_word_by_word(spark):
    rng = random.Random(5)
    words = ["the", "The,", "a", "of", "led", "Team", "data-driven", "o'er", "x1y2z3", "$5", "5ab", "|", "é", "ab", "abé", "the|", "A", "per", "12)", "•", "*"]
    lines = ["".join(rng.choice(words) + rng.choice((" ", "  ", "\t", " ")) for _ in range(rng.choice((0, 1, 2, 5, 12)))) for _ in range(1500)]
    lines += [f"{x} {y}" for x in ("the " * 40, "x" * 150, "*" * 120, "9" * 99 + ")", " " * 130, "lead " + "the " * 23 + "abcd efgh") for y in lines[:20]]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, t string").select("k", N.strong_phrase(F.col("t")).alias("p")).collect()
    assert {r.k: r.p for r in got} == {k: by_words(x) for k, x in enumerate(lines)} and sum(r.p is not None for r in got) > 300


def test_words_are_not_walked_one_by_one(spark):
    text = queries.QUERIES["phrase_briefs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in text and "substring(" in text
