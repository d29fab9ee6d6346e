"""Contracts of JSON records and whole records as documents: golden cases, each in one run."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sedgework.operators import contracts as C
from sedgework.operators import exports as X
from sedgework.operators import overlays as O

GOOD = {"id": "a", "title": "", "company": "x", "status": "new", "createdAt": 1, "updatedAt": 2.5}
RECORDS = {
    1: (json.dumps(GOOD | {"more": {"k": [1]}, "aliasUrls": []}), [], {"more": '{"k":[1]}'}), 2: (json.dumps(GOOD | {"id": "", "createdAt": "1", "aliasUrls": ["a", 1], "capture": []}), ["`id` must be a non-empty string.", "`createdAt` must be a finite number.", "`aliasUrls` must be a list of strings.", "`capture` must be an object."], None),
    3: ("{}", [f"`{n}` is required and must be {C.KINDS[k][1]}." for n, (k, r) in C.JOB.items() if r], None), 4: ("not json", ["The record must be a JSON object."], None), 5: ("[1]", ["The record must be a JSON object."], None), 6: (None, ["The record must be a JSON object."], None),
    7: (json.dumps(GOOD | {"x": {"__proto__": 1}}), ["A `__proto__` key is not accepted."], None), 8: (json.dumps(GOOD | {"notes": 'say "__proto__": no'}), [], {}), 9: (json.dumps(GOOD | {"url": None}), ["`url` must be a string."], None),
}


def test_contracts(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in RECORDS.items()], "k int, json string")
    got = {r.k: (r.reasons, r.extras) for r in C.checked(df, "json", C.JOB).collect()}
    assert got == {k: v[1:] for k, v in RECORDS.items()}


def test_exports(spark):
    from test_overlays import e

    names = ("contact", "summary", "experience", "education", "projects", "achievements", "certifications", "skills")
    rows = [
        (1, {"full_name": "Jane", "email": "j@x.org", "github_url": "https://github.com/j"}, "Does.", [e("Engineer", "Acme", "Jan 2019", "2021", description="Built A\n\nRan B"), e("Boss", None, "2021", None, True)], [e("BSc in Physics", "Northern")], [], [e("Prize", type="Award", year="2020")], [], ["SQL", "Go"]),
        (2, {}, None, [], [], [], [], [], []),
    ]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} {O.RECORD[n]}" for n in names))
    cols = [F.col(n) for n in names]
    got = {r.k: r for r in df.select("k", X.json_resume(*cols).alias("j"), X.markdown(*cols).alias("m")).collect()}
    assert json.loads(got[1].j) == {
        "basics": {"name": "Jane", "email": "j@x.org", "summary": "Does.", "profiles": [{"network": "GitHub", "url": "https://github.com/j"}]},
        "work": [{"name": "Acme", "position": "Engineer", "startDate": "2019-01", "endDate": "2021", "highlights": ["Built A", "Ran B"]}, {"position": "Boss", "startDate": "2021"}],
        "education": [{"institution": "Northern", "area": "Physics", "studyType": "BSc"}], "awards": [{"title": "Award · Prize", "date": "2020"}], "skills": [{"name": "SQL"}, {"name": "Go"}],
    }
    assert got[1].m == "# Jane\n\nj@x.org · https://github.com/j\n\n## Summary\n\nDoes.\n\n## Experience\n\n### Engineer — Acme · Jan 2019 – 2021\n- Built A\n- Ran B\n\n### Boss · 2021 – Present\n\n## Education\n\n### BSc in Physics — Northern\n\n## Achievements\n\n- Award · Prize, 2020\n\n## Skills\n\nSQL, Go"
    assert json.loads(got[2].j) == {"basics": {}} and got[2].m == ""
