"""Edits over records: golden cases in one run, no edits change nothing, edits again change nothing."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import oracle
from sedgework import queries
from sedgework.operators import overlays as O

SCHEMA = "id int, " + ", ".join(f"{n} {t}" for n, t in O.RECORD.items())
EDITS = "id int, " + ", ".join(f"{n.removeprefix('e_')} {t}" for n, t in O.EDIT.items())


def e(title=None, subtitle=None, start=None, end=None, current=False, description=None, **more):
    got = dict(title=title, subtitle=subtitle, location=None, team=None, type=None, year=None, start=start, end=end, current=current, description=description) | more
    return tuple(got[k] for k in (*O.FIELDS, "current", "description"))


BASE = {
    "contact": {"full_name": "Jane", "email": "j@x.org", "phone": "1"}, "confidence": {"email": 0.4, "location": 0.2}, "summary": "Does things.",
    "experience": [e("Engineer", "Acme", "2019", "2021", description="Built A\nRan B\nRan B"), e("Analyst", "Globex", "2015", None, True, "Counted C")],
    "education": [e("BSc", "Northern", None, "2014")], "projects": [e("Linter", description="Lints")], "achievements": [e("Best Paper", type="Award", year="2020"), e("Second Prize")], "certifications": None,
    "skills": ["SQL", "Python"], "lines": ["Jane", "• Built A", "• Ran B", "• Ran B", "Award · Best Paper, 2020", "Counted C"],
}
CASES = {
    1: {},
    2: {"contact": {"email": "", "phone": "2", "headline": "Boss"}, "summary": " "},
    3: {"fields": {"experience:0:title": "Lead", "experience:1:subtitle": "", "experience:0:start": "", "achievements:1:year": "2022", "projects:9:title": "none"}, "descriptions": {"projects:0": "", "experience:1": "Counts"}},
    4: {"bullets": [("0|built a", None), ("Built A", "Made A"), ("Made A", "Forged A"), ("ran  b", "Ran D"), ("Counted C", " "), ("nowhere", "x")], "removed_bullets": ["ran b", "gone"]},
    5: {"added": [("added:1", "experience", e("Chief", "Initech", None, "2024")), ("added:2", "certifications", e("CKA", year="2023", type=" "))], "added_bullets": {"added:1": ["Led", "Grew"], "projects:0": ["Shipped"], "projects:7": ["lost"]}},
    6: {"removed": ["achievements:0", "experience:1", "experience:", "projects:x", "added:1"], "fields": {"achievements:1:title": "Third Prize"}},
    7: {"skills_removed": ["sql"], "skills_added": ["Rust", " rust ", "python", ""]},
}


@pytest.fixture(scope="module")
def tables(spark):
    records = spark.createDataFrame([(k, *BASE.values()) for k in [*CASES, 8]] + [(9, *[None] * len(BASE))], SCHEMA)
    names = [n.removeprefix("e_") for n in O.EDIT]
    rows = [(k, *[c.get(n) for n in names]) for k, c in CASES.items()]
    return records, spark.createDataFrame(rows, EDITS)


@pytest.fixture(scope="module")
def got(tables):
    return {r.id: r for r in O.applied(*tables, "id").collect()}


def shown(entries):
    return [tuple(x) for x in entries]


def test_no_edit_changes_nothing(got):
    for k in (1, 8):
        r = got[k]
        assert r.contact == BASE["contact"] and r.confidence == BASE["confidence"] and r.summary == BASE["summary"] and r.skills == BASE["skills"] and r.lines == BASE["lines"]
        assert all(shown(r[s]) == (BASE[s] or []) for s in O.SECTIONS)
    assert got[9].contact == {} and got[9].experience == [] and got[9].summary is None


def test_contact_and_summary(got):
    r = got[2]
    assert r.contact == {"full_name": "Jane", "phone": "2", "headline": "Boss"} and r.summary is None
    assert r.confidence == {"email": 0.0, "location": 0.2, "phone": 1.0, "headline": 1.0}


def test_fields_and_descriptions(got):
    r = got[3]
    assert shown(r.experience) == [e("Lead", "Acme", "2021", None, False, "Built A\nRan B\nRan B"), e("Analyst", None, "2015", None, True, "Counts")]
    assert r.achievements[1].year == "2022" and r.projects[0].description is None and len(r.projects) == 1


def test_bullets_are_edited_in_order_and_once(got):
    r = got[4]
    assert r.experience[0].description == "Forged A\nRan D" and r.experience[1].description == "Counted C"
    assert r.lines == ["Jane", "Forged A", "Ran D", "Award · Best Paper, 2020", "Counted C"]


def test_added_entries_and_bullets(got):
    r = got[5]
    assert shown(r.experience)[2] == e("Chief", "Initech", "2024", None, False, "Led\nGrew")
    assert shown(r.certifications) == [e("CKA", year="2023")] and r.projects[0].description == "Lints\nShipped"
    assert r.lines[6:] == ["• Led", "• Grew", "• Shipped"]


def test_entries_go_last(got):
    r = got[6]
    assert [x.title for x in r.achievements] == ["Third Prize"] and [x.title for x in r.experience] == ["Engineer"] and len(r.projects) == 1
    assert r.lines == ["Jane", "• Built A", "• Ran B", "• Ran B", "Counted C"]


def test_skills(got):
    assert got[7].skills == ["Python", "Rust"]


def test_values_laid_over_again_change_nothing(tables):
    records, edits = tables
    some = edits.where("id in (2, 7)").select("id", "contact", "summary", "skills_removed", "skills_added")
    once = O.applied(records.withColumn("more", F.lit(1)), some, "id")
    assert sorted(map(str, once.collect())) == sorted(map(str, O.applied(once, some, "id").collect()))


def test_repeated_customers(spark, tmp_path):
    """A key that the table of customers has twice is not multiplied by its edits, and keys that are null keep their rows."""
    spark.createDataFrame([(7, "a"), (7, "a"), (None, "b"), (6, "c")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 7, "low"), (2, 7, "high"), (3, 6, "low")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r.c_custkey or 0, r.titles, r.phone, r.lines) for r in queries.QUERIES["applied_overrides"](spark, str(tmp_path)).collect())
    assert got == [(0, "", "b", 0), (6, "Lead", "new", 1), (7, "low|high|Chief", "a", 3), (7, "low|high|Chief", "a", 3)]


def test_a_removal_never_takes_an_added_entry(spark):
    """``experience:1`` of a record of one entry names none, so an entry added behind it stays; a name that is null removes nothing."""
    records = spark.createDataFrame([(1, [e("Engineer")], ["Chief"])], f"id int, experience array<{O.ENTRY}>, lines array<string>")
    edits = [(1, [("added:1", "experience", e("Chief"))], ["experience:1", None])]
    r = O.applied(records, spark.createDataFrame(edits, f"id int, added {O.EDIT['e_added']}, removed array<string>"), "id").first()
    assert [x.title for x in r.experience] == ["Engineer", "Chief"] and r.lines == ["Chief"]


def test_customers_as_in_sql(spark, tmp_path):
    """A removal that names no order beside an entry added, and customers whose segment is empty."""
    spark.createDataFrame([(35, "a"), (70, "b"), (105, ""), (11, "")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 35, "low"), (2, 105, "low"), (3, 105, "high"), (4, 11, None)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert oracle.difference(queries.QUERIES["applied_overrides"](spark, str(tmp_path)), con, queries.SQL["applied_overrides"]) == ""
