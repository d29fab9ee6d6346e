"""Degrees, grades, projects and the right to work: golden cases, each in one run."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgework.functions import credentials as C
from sedgework.operators import credentials as R

DEGREES = {
    "B.Sc. in Computer Science": ("B.Sc.", "Computer Science"), "Bachelor of Science in Physics, Minor in Economics": ("Bachelor of Science", "Physics"), "Master of Business Administration": ("Master of Business Administration", None),
    "Bachelor of Arts History": ("Bachelor of Arts", "History"), "BA, Mathematics · Statistics": ("BA", "Mathematics · Statistics"), "M.S. - Computer Science, cum laude, GPA: 3.72/4.00": ("M.S.", "Computer Science"),
    "BSc Computer Science   Sep. 2024 - Jun. 2027": ("BSc", "Computer Science"), "BS Computer Science GPA 3.8": ("BS", "Computer Science"), "PhD, GPA 3.9": ("PhD", None), "Associate, Major in Data Science": ("Associate", "Major in Data Science"),
    "Bachelor of Design | Northern College": ("Bachelor of Design", None), "Northern College": ("", None), "": ("", None),
}
GRADES = {
    ("GPA: 3.8",): ("3.8", None), ("BSc, CGPA 8.7/10, magna cum laude",): ("8.7/10", "magna cum laude"), ("3.83 / 4.0 GPA",): ("3.83 / 4.0", None), ("First Class Honours 2019",): ("First Class Honours", None),
    ("Honors: with distinction", "Cum. GPA - 91%"): ("91%", "with distinction"), ("Second-class upper division",): ("Second-class upper division", None), ("Second-class ticket",): (None, None), ("2:1 · graduated with highest honours",): ("2:1", "graduated with highest honours"),
    ("Northern College  First Division",): ("First Division", None), ("GPAs are overrated 3",): (None, None), (): (None, None), ("GPA 12345",): (None, None),
}
WORK = {
    "US Citizen": True, "Dual US/UK Citizen": True, "Global Citizen": False, "Green card holder.": True, "Lawful  Permanent Resident": True, "Permanent resident of Seattle": False, "Authorized to work in the US without sponsorship": True,
    "Authorized to work with cross-functional teams": False, "Authorized to work": False, "Right to work in the UK": True, "Right to Work laws in Texas": False, "Work authorization: H-1B": True, "Visa status: TN": True, "Citizenship: US / Canadian": True,
    "Citizenship: Hero of the hour": False, "No visa sponsorship required": True, "Visa sponsorship not needed now or in the future": True, "EU passport holder": True, "Vaccine passport holder": False, "Work authorized": True, "": False, "Engineer": False,
}


def test_degrees(spark):
    df = spark.createDataFrame([(k,) for k in DEGREES], "t string").select("t", C.degree_and_field(F.col("t")).alias("d"))
    assert {r.t: (r.d.degree, r.d.field) for r in df.collect()} == DEGREES


def test_grades(spark):
    df = spark.createDataFrame([(list(k),) for k in GRADES], "t array<string>").select("t", C.grade_and_honors(F.col("t")).alias("g"))
    assert {tuple(r.t): (r.g.gpa, r.g.honors) for r in df.collect()} == GRADES


def test_the_right_to_work(spark):
    df = spark.createDataFrame([(k,) for k in WORK] + [(None,)], "t string").select("t", C.work_authorization(F.col("t")).alias("w"))
    assert {r.t: r.w is not None for r in df.collect()} == WORK | {None: False}
    lines = spark.createDataFrame([("a", 1, "Berlin | EU citizen | me@x.org"), ("a", 2, "UK citizen"), ("b", 1, "nothing"), ("c", 1, None)], "k string, ord int, text string")
    assert [tuple(r) for r in R.work_authorizations(lines, ["k"]).collect()] == [("a", "EU citizen")]


BLOCK = "k string, header_lines array<string>, start string, end string, current boolean, body string, bullets int"


def test_schools_and_projects(spark):
    rows = [
        ("a", ["Northern College", "B.Sc. in Physics, GPA: 3.8"], "2014", "2018", False, "Thesis", 1), ("b", ["University of Kent | BA, History"], "2016", None, False, None, 0), ("c", ["Evening class"], None, None, False, None, 0), ("d", None, None, None, False, None, 0),
    ]
    got = {r.k: (r.institution, r.degree, r.field, r.gpa, r.dates.start, r.dates.end) for r in R.education(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {"a": ("Northern College", "B.Sc.", "Physics", "3.8", "2014", "2018"), "b": ("University of Kent", "BA", "History", None, None, "2016")}
    rows = [("a", ["Linter | github.com/me/lint"], "2024", None, False, "x", 2), ("b", ["Sold acme.com to a buyer | https://x.org/repo", "React"], None, None, False, None, 0), ("c", [], "2020", None, False, None, 1)]
    got = {r.k: (r["name"], r.url, r.confidence) for r in R.projects(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {"a": ("Linter", "github.com/me/lint", 1.0), "b": ("Sold acme.com to a buyer", "https://x.org/repo", 0.4)}


def test_costly_parts_are_computed_once():
    """A line's dates, degree and grades are found once, however many fields are read off them: expressions don't hold copies of each other."""
    from sedgework.functions import credentials as C
    from sedgework.functions import dates as T

    size = lambda c: str(c).count("regexp_extract") + str(c).count("regexp_replace") + str(c).count("rlike")
    x = F.col("x")
    assert size(T.education_dates(x)) < 120 and size(C.degree_and_field(x)) < 60 and size(C.grade_and_honors(x)) < 60
