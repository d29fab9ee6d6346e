"""Sections by name and by style: golden cases, all in two runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sedgework.operators import sections as S

HEADINGS = {
    "EXPERIENCE": ("experience", False), "Work Experience:": ("experience", False), "Relevant Experience": ("experience", False), "Other Leadership Experience": ("experience", False),
    "E XPERIENCE": ("experience", False), "S KILLS": (None, False), "¥Skills": ("skills", False), "• Skills": (None, False), "Awards & Honors": ("achievements", False), "Certifications & Activities": ("certifications", False),
    "Public speaking and leadership": ("experience", False), "• Public speaking and leadership": (None, False), "Teaching Experience": ("experience", True), "IT Experience": ("experience", True),
    "5 Years Experience": (None, False), "i have experience": (None, False), "ACME Professional Education": (None, False), "Harvard University Education": (None, False), "University Projects": ("projects", True),
    "High School Coursework": ("education", True), "Programming Skills": (None, False), "A Very Long Qualified Experience": (None, False), "I love Experience.": (None, False), "": (None, False), "hobbies": ("other", False), None: (None, False),
}


def test_headings_by_name(spark):
    df = spark.createDataFrame([(t,) for t in HEADINGS], "t string").select("t", S.section_of(F.col("t")).alias("s"))
    assert {r.t: (r.s.section, bool(r.s.soft)) for r in df.collect()} == HEADINGS


#: text, font, gap above, band -> nth section, its name, whether the line opens it
CASES = {
    "plain": [
        ("Jane Doe", 20, 0, None, 0, "profile", 0), ("Data Engineer", 16, 14, None, 0, "profile", 0), ("jane@example.com", 10, 14, None, 0, "profile", 0), ("EXPERIENCE", 12, 28, None, 1, "experience", 1), ("Acme 2019 - 2021", 10, 14, None, 1, "experience", 0),
        ("• Built things with a team", 10, 14, None, 1, "experience", 0), ("Side Quests", 13, 28, None, 2, "other", 1), ("Kayaking in the evening hours", 10, 14, None, 2, "other", 0), ("SKILLS", 12, 28, None, 3, "skills", 1), ("HTML", 10, 40, None, 3, "skills", 0), ("Python, SQL and other languages", 10, 14, None, 3, "skills", 0),
    ],
    "by gap": [("x@example.com", 10, 0, None, 0, "profile", 0), ("some body text here", 10, 14, None, 0, "profile", 0), ("and some more body text", 10, 14, None, 0, "profile", 0), ("PATENTS", 10, 28, None, 1, "other", 1), ("A machine", 10, 14, None, 1, "other", 0), ("TALKS", 10, 14, None, 1, "other", 0), ("MEDIA COVERAGE", 10, 14, None, 2, "other", 1)],
    "schools": [("EDUCATION", 10, 0, None, 1, "education", 1), ("Riverside School of Education", 10, 14, None, 1, "education", 0), ("Graduate Education", 10, 14, None, 1, "education", 0), ("PROJECTS", 10, 14, None, 2, "projects", 1), ("Graduate Education", 10, 14, None, 3, "education", 1)],
    "groups": [("Performance Experience", 10, 0, None, 1, "experience", 1), ("Stage Experience", 10, 14, None, 1, "experience", 0), ("Actor 2019 - 2020", 10, 14, None, 1, "experience", 0), ("Teaching Experience", 10, 14, None, 2, "experience", 1), ("Tutor", 10, 14, None, 2, "experience", 0), ("Global Teaching Experience", 10, 14, None, 2, "experience", 0), ("Jan 2020 - May 2021", 10, 14, None, 2, "experience", 0)],
    "two columns": [("EXPERIENCE", 10, 0, "body", 1, "experience", 1), ("Work here Experience", 10, 14, "body", 1, "experience", 0), ("20% Projects", 10, 14, "sidebar", 2, "projects", 1), ("5 Years Projects", 10, 14, "body", 2, "projects", 0)],
    "blank": [(None, 10, 0, None, 0, "profile", 0), ("", 10, 14, None, 0, "profile", 0)],
    "headerless": [("me@example.com", 10, 0, None, 0, "profile", 0), ("Engineer, Acme  Jan 2019 - Present", 10, 14, None, 0, "profile", 0), ("• Built", 10, 14, None, 0, "profile", 0), ("Analyst, Globex  2016 - Mar 2018", 10, 14, None, 0, "profile", 0), ("SKILLS", 10, 14, None, 1, "skills", 1), ("SQL", 10, 14, None, 1, "skills", 0)],
}


@pytest.fixture(scope="module")
def split(spark):
    rows = [(k, i, t, float(f), float(g), b, 50.0, float(14 * i)) for k, lines in CASES.items() for i, (t, f, g, b, *_) in enumerate(lines)]
    return S.sections(spark.createDataFrame(rows, "name string, ord int, text string, font double, gap double, band string, x double, y double"), ["name"]).cache()


def test_lines_go_to_their_sections(split):
    got = {(r.name, r.ord): (r.nth, r.section, int(r.is_heading)) for r in split.collect()}
    want = {(k, i): tuple(x[4:]) for k, lines in CASES.items() for i, x in enumerate(lines)}
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}
    assert {r.heading for r in split.where("section = 'projects'").collect()} == {"PROJECTS", "Projects"}


def test_experience_without_a_heading_is_recovered(split):
    got = {(r.name, r.ord): (r.nth, r.section) for r in S.recovered_experience(split, ["name"]).collect()}
    assert [got["headerless", i] for i in range(6)] == [(0, "profile"), *[(1, "experience")] * 3, *[(2, "skills")] * 2]
    assert all(got[r.name, r.ord] == (r.nth, r.section) for r in split.collect() if r.name != "headerless")


def test_sections_of_one_name_are_one(split):
    got = {(r.name, r.section): (r.heading, r.lines) for r in S.by_name(split, ["name"]).collect()}
    assert got["groups", "experience"] == ("Performance Experience", ["Stage Experience", "Actor 2019 - 2020", "Tutor", "Global Teaching Experience", "Jan 2020 - May 2021"])
    assert got["schools", "education"] == ("EDUCATION", ["Riverside School of Education", "Graduate Education"]) and got["schools", "projects"] == ("PROJECTS", [])
    assert got["blank", "profile"] == (None, [])
