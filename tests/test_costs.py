"""What is computed of a row is computed once, and rows of small tables are dealt out before it: read from plans, as results don't show it."""

from __future__ import annotations

import re

import pytest

from sedgework import queries


def plan(spark, name: str, kind: str = "optimizedPlan") -> str:
    return getattr(queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution(), kind)().toString()


def times(text: str, *words: str) -> int:
    return sum(len(re.findall(w, text, re.I)) for w in words)


@pytest.mark.parametrize(("name", "most"), [("reference_links", 20), ("web_profiles", 45), ("captured_jobs", 60)])
def test_patterns_are_applied_once(spark, name, most):
    assert times(plan(spark, name), "regexp_", "rlike") <= most


@pytest.mark.parametrize("name", ["reference_links", "web_profiles"])
def test_rows_of_small_tables_are_dealt_out(spark, name):
    assert "hashpartitioning" in plan(spark, name, "executedPlan")


@pytest.mark.parametrize(("name", "passes"), [("names_and_headlines", 1), ("named_sections", 1), ("section_contents", 1), ("entry_blocks", 1), ("project_entries", 2)])
def test_lines_are_read_in_one_pass(spark, name, passes):
    """The texts are shuffled, not their lines; only lists of bullets, which are no dated entries, are a second pass."""
    text = plan(spark, name, "executedPlan")
    lines = text.split("== Initial Plan ==")[-1]
    assert times(lines, "Exchange hashpartitioning") == times(lines, "FileScan parquet") <= 2 * passes and ("Join" not in lines or passes == 2)


def test_runs_of_characters(spark):
    """Runs of code points in one walk; a text shorter than a run is its own."""
    from pyspark.sql import functions as F

    from sedgework.operators.nearest import grams

    rows = spark.createDataFrame([("abcabc",), ("ab",), ("a\U0001f600bc",), (None,)], "t string").select(grams(F.col("t"), 3).alias("g")).collect()
    assert [r["g"] for r in rows] == [["abc", "bca", "cab"], ["ab"], ["a\U0001f600b", "\U0001f600bc"], None]
    assert "substring(__t" not in plan(spark, "localized_values")
