"""Names, headlines and markdown lines: golden cases, each in one run."""

from __future__ import annotations

import pytest

from sedgework.operators import names as N
from sedgework.sources import markdown as M

TOPS = {
    "plain": [("Jane Doe", 20), ("Data Engineer", 12), ("jane@x.org", 10)],
    "boilerplate": [("Functional Resume Sample", 22), ("Jane Doe", 18), ("j@x.org", 10)],
    "mononym": [("Etta", 24), ("Product Designer", 12)],
    "small mononym": [("Etta", 10), ("Jane Doe", 24)],
    "stacked": [("JANE", 24), ("DOE", 24), ("me@x.org | 2020", 10)],
    "title first": [("Senior Marketing Manager", 24), ("Jane Doe", 14), ("j@x.org", 10)],
    "school": [("Northern University", 24), ("Jane Doe", 14)],
    "none": [("1 Main Street 55", 12), ("a@b.org", 12), (None, 12)],
    "section": [("Jane Doe", 20), ("SUMMARY", 12), ("Software Engineer", 12)],
    "late": [("Jane Doe", 20), ("line two here", 10), ("line three here", 10), ("line four here", 10), ("line five here", 10), ("Software Engineer", 10)],
}
NAMES = {"plain": "Jane Doe", "boilerplate": "Jane Doe", "mononym": "Etta", "small mononym": "Jane Doe", "stacked": "JANE DOE", "title first": "Jane Doe", "school": "Jane Doe", "section": "Jane Doe", "late": "Jane Doe"}
HEADLINES = {"plain": "Data Engineer", "mononym": "Product Designer", "title first": "Senior Marketing Manager"}


def test_names_and_headlines(spark):
    rows = [(k, i, t, float(f), 14.0 * i) for k, lines in TOPS.items() for i, (t, f) in enumerate(lines)]
    lines = spark.createDataFrame(rows, "doc string, ord int, text string, font double, y double")
    found = N.names(lines, ["doc"])
    got = {r.doc: (r.name, r.confidence) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == NAMES
    assert got["plain"][1] == 1.0 and got["mononym"][1] == pytest.approx(0.4 + 0.3 + 0.1 + 0.2 - 0.1) and all(0.5 <= c <= 1 for _, c in got.values())
    assert {r.doc: r.headline for r in N.headlines(lines, found, ["doc"]).collect()} == HEADLINES


TEXTS = {
    "heads": ("# **Jane** Doe\n\n## Work Experience ##\n#### S UMMARY\n**Education**\n**" + "long " * 15 + "**", [("Jane Doe", 16, "heading"), ("Work Experience", 14, "heading"), ("SUMMARY", 12, "heading"), ("Education", 12, "label"), (("long " * 15).strip(), 10, "label")]),
    "body": ("- *Built* **it**\n  * snake_case_name _and_ more\nTECHNICAL SKILLS\n| SQL | **Py** |\n|---|---|\n|  |  |\nsome \\_text\\_", [("- Built it", 10, "bullet"), ("* snake_case_name and more", 10, "bullet"), ("TECHNICAL SKILLS", 12, "capitals"), ("SQL | Py", 10, "row"), ("some text", 10, "text")]),
    "links": ("![x](y.png)See [site](https://x.org \"T\") and <https://y.org>, [ref][r]\n\n[r]: https://z.org", [("See site https://x.org and https://y.org, ref https://z.org", 10, "text")]),
    "none": (None, []), "blank": (" \n\n", []),
}


def test_markdown_lines(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in TEXTS.items()], "doc string, md string")
    got = M.markdown_lines(df, "doc", "md").orderBy("doc", "ord").collect()
    assert {k: [(r.text, r.font, r.kind) for r in got if r.doc == k] for k in TEXTS} == {k: v[1] for k, v in TEXTS.items()}
    assert [r.ord for r in got if r.doc == "body"] == list(range(5))


def test_markdown_sections(spark):
    lines = ["Jane Doe", "EXPERIENCE 04/2021 - Present", "Acme", "Teaching Experience", "EDUCATION", "ACME Institute Education", "Graduate Education", "skills in many things and much more than a heading would ever say of them", None, "Skills: SQL"]
    rows = [("a", i, t) for i, t in enumerate(lines)]
    got = M.markdown_sections(spark.createDataFrame(rows, "doc string, ord int, text string"), ["doc"]).orderBy("ord").collect()
    assert [(r.nth, r.section, r.is_heading) for r in got] == [(0, "profile", False), (1, "experience", True), (1, "experience", False), (1, "experience", False), (2, "education", True), (2, "education", False), (2, "education", False), (2, "education", False), (2, "education", False), (2, "education", False)]
    assert got[2].heading == "EXPERIENCE 04/2021 - Present"
