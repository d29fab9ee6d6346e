"""Searches against profiles: golden cases in one run."""

from __future__ import annotations

from sedgework.operators import coherence as C

PROFILES = [
    (0, "engineering", ["backend engineer", "software engineer"], ["python", "sql", "docker", "kafka", "rest api"]), (1, "leadership", ["engineering manager", "head of engineering"], ["hiring", "budgeting", "mentoring", "roadmap", "team building"]),
    (2, "data", ["data engineer"], ["spark", "sql", "airflow", "python"]), (3, "leadership", ["director of data"], ["strategy", "hiring", "budgeting"]),
]
QUERIES = {
    1: (["Senior Backend Engineer"], ["Python", "SQL", "Knitting", "go to"], [], ["knitting"]), 2: (["Engineering Manager"], ["Python", "SQL", "Docker", "Kafka"], [], None), 3: (["Backend Engineer"], ["hiring", "budgeting", "mentoring", "roadmap"], None, None),
    4: (["Backend Engineer"], ["hiring", "budgeting", "mentoring", "python"], None, None), 5: (["Berlin", "of"], [], ["berlin"], None), 6: (None, None, None, None), 7: (["Poet"], ["docker & kafka", "sql"], None, ["sql"]),
}


def test_searches(spark):
    profiles = spark.createDataFrame(PROFILES, "profile int, family string, titles array<string>, skills array<string>")
    queries = spark.createDataFrame([(k, *v) for k, v in QUERIES.items()], "k int, titles array<string>, skills array<string>, noise array<string>, canonical array<string>")
    got = {r.k: r for r in C.assessed(queries, profiles, "k").collect()}
    assert set(got) == set(QUERIES)
    v = lambda k: [(x.term, x.quality) for x in got[k].verdicts]
    m = lambda k: [x.term for x in got[k].missing]
    assert v(1) == [("Senior Backend Engineer", "strong"), ("Python", "strong"), ("SQL", "strong"), ("Knitting", "weak")] and got[1].direction is None
    assert m(1) == ["software engineer", "docker", "kafka", "rest api"]
    assert got[2].direction == "leadership-titles-ic-skills" and got[2].named == ["Engineering Manager"] and got[2].off_axis == ["Python", "SQL", "Docker", "Kafka"] and got[2].advised == PROFILES[1][3]
    assert got[3].direction == "ic-titles-leadership-skills" and got[4].direction is None and got[4].named == []
    assert v(5) == [("Berlin", "noise"), ("of", "noise")] and v(6) == [] and m(6) == []
    assert v(7) == [] and m(7) == []


def test_equal_searches_are_judged_once(spark):
    """Copies of a search all come back, and the profiles' lists are not laid beside each copy."""
    profiles = spark.createDataFrame(PROFILES, "profile int, family string, titles array<string>, skills array<string>")
    one = (["Senior Backend Engineer"], ["Python", "SQL"], [], [])
    queries = spark.createDataFrame([(k, *one) for k in range(40)] + [(40, ["Poet"], ["sql"], None, None)], "k int, titles array<string>, skills array<string>, noise array<string>, canonical array<string>")
    got = {r.k: (r.verdicts, r.missing) for r in C.assessed(queries, profiles, "k").collect()}
    assert len(got) == 41 and all(got[k] == got[0] for k in range(40)) and got[40] != got[0]
