"""Records in no pair go past the joins of a merge; a canonical form is computed once."""

from __future__ import annotations

import re

from sedgework import queries
from sedgework.operators import tracker as T


def test_pairs_alone_are_joined(spark):
    text = queries.QUERIES["merged_jobs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in text and len(re.findall("LeftAnti", text)) == 1


def test_ids_are_not_broadcast(spark):
    text = queries.QUERIES["merged_jobs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall(r"SortMergeJoin \[(?:survivor|absorbed)#\d+L?\], \[(?:survivor|absorbed)#", text)) >= 2


def test_repeated_ids_and_records_in_no_pair(spark):
    jobs = spark.createDataFrame([(1, "", ["https://a.b/x"], None), (1, "t", None, "n"), (2, "u", None, "m"), (3, "v", None, None)], "id long, title string, alias_urls array<string>, notes string").selectExpr("id", "CAST(NULL AS STRING) AS url", "title", "alias_urls", "notes")
    letters = spark.createDataFrame([("l", 2)], "letter string, job_id long")
    records, moved = T.merged(jobs, letters, spark.createDataFrame([(1, 2), (9, 3)], "survivor long, absorbed long"))
    assert sorted((r.id, r.title, r.notes, r.alias_urls or []) for r in records.collect() if r.id == 1) == [(1, "t", "n\n\nm", []), (1, "u", "m", ["https://a.b/x"])]
    assert [(r.id, r.title) for r in records.collect() if r.id != 1] == [(3, "v")] and moved.first().job_id == 1
