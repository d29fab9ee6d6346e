"""Heads of entries: golden cases, and the assignment against all permutations."""

from __future__ import annotations

import random
from itertools import permutations

from pyspark.sql import functions as F

from sedgework.functions import shapes as H
from sedgework.operators import header_fields as A

CASES = {  # document, lines, anchor -> title, company, location, team
    1: ("a", ["Senior Engineer", "Acme Corp"], 1, ("Senior Engineer", "Acme Corp", None, None)),
    2: ("a", ["Senior Engineer · Acme · Berlin, Germany"], 0, ("Senior Engineer", "Acme", "Berlin, Germany", None)),
    3: ("a", ["Data Analyst, Northwind Retail Co. | Austin, TX"], 0, ("Data Analyst", "Northwind Retail Co.", "Austin, TX", None)),
    4: ("a", ["Globex Inc @ Remote", "Product Manager"], 0, ("Product Manager", "Globex Inc", "Remote", None)),
    5: ("b", ["Initech", "Relationship Banking"], 0, ("Initech", "Relationship Banking", None, None)),
    6: ("c", ["Acme Labs | Engineer"], 0, ("Engineer", "Acme Labs", None, None)),
    7: ("c", ["Globex Systems | Analyst"], 0, ("Analyst", "Globex Systems", None, None)),
    8: ("c", ["Northern Trust | Relationship Banking"], 0, ("Relationship Banking", "Northern Trust", None, None)),
    9: ("d", ["Lead Designer — Payments — Initrode LLC"], 0, ("Lead Designer", "Initrode LLC", None, "Payments")),
    10: ("d", [], -1, (None,) * 4),
    11: ("d", ["Software Engineer"], 0, ("Software Engineer", None, None, None)),
    12: (None, ["Chicago"], 0, (None, None, "Chicago", None)),
    13: ("e", ["Nurse", "St. Mary Hospital"], 1, ("Nurse", "St. Mary Hospital", None, None)),
}


def test_golden_heads(spark):
    rows = [(c[0], k, c[1], c[2]) for k, c in CASES.items()]
    got = A.header_fields(spark.createDataFrame(rows, "doc string, entry int, header_lines array<string>, anchor_index int"), ["doc"])
    assert {r.entry: (r.title, r.company, r.location, r.team) for r in got.collect()} == {k: c[3] for k, c in CASES.items()}


def test_assignment_is_the_best_of_all(spark):
    rng = random.Random(4)
    rows = [(k, [[rng.randrange(-60, 61) for _ in range(4)] for _ in range(rng.randrange(0, 7))], rng.choice((None, True, False))) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, s array<array<int>>, v boolean")
    got = {r.k: (r.a["sum"], list(r.a["of"])) for r in df.select("k", A.assigned(F.col("s"), F.col("v")).alias("a")).collect()}
    for k, s, v in rows:
        best = max(
            sum(s[p][f] for f, p in enumerate(o) if p >= 0) + (A.VOTE if v is not None and o[0] >= 0 and o[1] >= 0 and (o[0] < o[1]) == v else 0)
            for o in set(permutations([*range(len(s)), -1, -1, -1, -1], 4))
        )
        total, of = got[k]
        assert total == best and len({p for p in of if p >= 0}) == sum(p >= 0 for p in of)


def test_places(spark):
    places = {"TX": True, "Austin, TX": True, "austin": True, "Berlin, Germany": True, "Buyer, Home Goods": False, "Mountain View": True, "Mountain View Software": False, "Seoul, S.Korea": True, "New York, ZZ": False, "": False}
    df = spark.createDataFrame([(p,) for p in places], "p string")
    assert {r.p: r.b for r in df.select("p", H.is_bare_place(F.col("p")).alias("b")).collect()} == places


def test_assignments_of_few_parts_are_few(spark):
    """Heads of few parts try only assignments of these parts, and find the best of all."""
    from itertools import permutations

    for rows in ([[5, 4, -50, 1]], [[-20, 40, -30, 2], [40, -20, -30, 2]], [[5, 4, -50, 1], [4, 5, -50, 1], [-40, -40, 60, -20]]):
        scores = F.array(*[F.array(*map(F.lit, r)) for r in rows])
        got = spark.range(1).select(A.assigned(scores, F.lit(None).cast("boolean")).alias("a")).first().a
        best = max(sum(rows[o[k]][k] for k in range(4) if o[k] >= 0) for o in permutations([*range(len(rows)), -1, -1, -1, -1], 4))
        assert got["sum"] == best and max(got["of"]) < len(rows)
    assert str(A.assigned(F.col("s"), F.lit(None).cast("boolean"))).count("size(s)") == A.MOST_PARTS


def test_looks_and_votes_are_judged_once(spark):
    """A part's looks are computed once, and assigned again are only heads that a vote can change."""
    rows = spark.createDataFrame([("a", 1, ["Engineer"], 0)], "doc string, entry int, header_lines array<string>, anchor_index int")
    plan = A.header_fields(rows, ["doc"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Technologies") <= 4 and "explode(array(struct(__k" in plan and "ELSE __first" in plan.replace("__once.", "").replace("_once", "")


def test_votes_change_what_they_can(spark):
    """Against a second assignment of every head: random heads, some with votes against their own order."""
    rng = random.Random(8)
    words = ["Engineer", "Acme Corp", "Berlin, Germany", "Blue", "Data Analyst", "State University", "TX", "Payments"]
    heads = [(d, k, [" | ".join(rng.sample(words, rng.randrange(1, 5))) for _ in range(rng.randrange(1, 3))], rng.randrange(-1, 2)) for d in range(25) for k in range(6)]
    df = spark.createDataFrame(heads, "doc int, entry int, header_lines array<string>, anchor_index int")
    kinds = F.transform("p", lambda p: A.looks(p["text"]))
    each = df.withColumn("p", A.parts_of(F.col("header_lines"))).withColumn("k", kinds).withColumn("s", A.points(F.col("p"), F.col("k"), F.col("anchor_index")))
    first = each.withColumn("o", A.assigned(F.col("s"))["of"]).select("*", (F.get("k", F.get("o", 0)) == "title").alias("t"), (F.get("k", F.get("o", 1)) == "company").alias("c")).collect()
    votes = {}
    for r in first:
        if r.o[0] >= 0 and r.o[1] >= 0 and (r.t or r.c):
            votes[r.doc] = votes.get(r.doc, 0) + (1 if r.o[0] < r.o[1] else -1)
    given = spark.createDataFrame([(d, None if not v else v > 0) for d, v in votes.items()], "doc int, v boolean")
    every = each.join(given, "doc", "left").withColumn("o", A.assigned(F.col("s"), F.col("v"))["of"]).collect()
    name = lambda r, k: r.p[r.o[k]].text if r.o[k] >= 0 else None
    want = {(r.doc, r.entry): (name(r, 0), None if name(r, 1) == name(r, 0) else name(r, 1), name(r, 2), name(r, 3)) for r in every}
    got = {(r.doc, r.entry): (r.title, r.company, r.location, r.team) for r in A.header_fields(df, ["doc"]).collect()}
    assert got == want and [r.o for r in first] != [r.o for r in sorted(every, key=lambda r: (r.doc, r.entry))]


def test_fields_need_no_bodies(spark):
    """Heads are the same without bodies, and the query puts none together."""
    from sedgework import queries
    from sedgework.operators import entries as E

    lines = [("a", k, t, 50.0, 14.0 * k) for k, t in enumerate(["Engineer, Acme", "Jan 2019 - May 2021", "• Built A", "runs on", "• Ran B", "Analyst", "2015 - 2017", "Globex", "• Counted C"])]
    df = spark.createDataFrame(lines, "doc string, ord int, text string, x double, y double")
    heads = [sorted((r.entry, tuple(r.header_lines), r.anchor_index) for r in E.entry_blocks(df, ["doc"], E.Entries(body=b)).collect()) for b in (True, False)]
    assert heads[0] == heads[1] and len(heads[0]) == 2
    made = lambda name: queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("struct(entry, ")
    assert made("entry_fields") < made("entry_blocks")
