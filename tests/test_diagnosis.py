"""What parses have missed: golden cases in one run."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgework.operators import diagnosis as D

DOCS = {  # markdown, {section: lines}, {section: entries} -> defects, missed
    1: ("# SKILLS", {"experience": ["Acme 2019 - 2020", "• x"], "skills": ["SQL"], "education": ["BSc, 2014"], "achievements": ["Prize", "• of the year"]}, {"experience": 1, "skills": 3, "education": 1, "achievements": 1}, [], []),
    2: ("## ¥Programming skills\nSQL\n\nPython\n# Other", {"experience": ["Acme 2019 - 2020", "Globex 2017 - 2019"]}, {"experience": 1}, ["experience-under-segmented", "skills-header-unrecognized", "education-no-section", "achievements-no-section"], ["skills: ¥Programming skills"]),
    3: (None, {"experience": ["Acme 2019 - 2020"], "skills": ["SQL"], "education": ["BSc and MSc"], "achievements": ["A", "B"]}, {"education": 1, "achievements": 1}, ["experience-parser-miss", "skills-extraction-miss", "education-under-chunked", "achievements-under-segmented"], []),
    4: (None, {}, {}, ["achievements-no-section"], []),
    5: ("### My education and more\nBSc", {}, {"skills": 1}, ["education-header-unrecognized", "achievements-no-section"], ["education: My education and more"]),
}


def test_defects(spark):
    documents = spark.createDataFrame([(k, v[0]) for k, v in DOCS.items()], "k int, md string")
    sections = spark.createDataFrame([(k, s, lines) for k, v in DOCS.items() for s, lines in v[1].items()], "k int, section string, lines array<string>")
    entries = spark.createDataFrame([(k, s, n) for k, v in DOCS.items() for s, n in v[2].items()], "k int, section string, n int")
    got = {r.k: (r.defects, r.missed) for r in D.defects(documents, sections, entries, "k", "md").collect()}
    assert got == {k: (v[3], v[4]) for k, v in DOCS.items()}


def test_orphans(spark):
    df = spark.createDataFrame([(DOCS[2][0], "¥Programming skills"), (DOCS[2][0], "none")], "md string, h string")
    assert [r.o for r in df.select(D.orphan_lines(F.col("md"), F.col("h")).alias("o")).collect()] == [["SQL", "Python"], []]
