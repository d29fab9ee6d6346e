"""Pay in texts and merges of tracked records: golden cases, each in one run."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgework.functions import pay as P
from sedgework.operators import tracker as T

PAY = {
    "Salary: $120,000 - $150,000 per year": (120000, 150000, "USD", "year"), "£45k to £60K": (45000, 60000, "GBP", "year"), "EUR 30–35/hr for you": (30, 35, "EUR", "hour"), "between $90k and 110k annually": (90000, 110000, "USD", "year"),
    "saved $5 and 20 people": None, "from $200k and $100k": None, "raised $5M and we pay $100k": (100000, 100000, "USD", "year"), "$50 billion market": None, "CAD 9,000 a month. Pay: CAD 8,500/month": (8500, 8500, "CAD", "month"),
    "costs $29/month": None, "$75/hr": (75, 75, "USD", "hour"), "We won $3,000. Salary is fair": None, "base of $3,000; bonus $500": (3000, 3000, "USD", "year"), "$10 pay $10": (10, 10, "USD", "year"), "($10) pay ($10)": None, "90k salary": None, "$90kg": None, "": None, None: None,
}


def test_pay(spark):
    df = spark.createDataFrame([(t,) for t in PAY], "t string").select("t", P.pay(F.col("t")).alias("p"))
    got = {r.t: r.p and (r.p["min"], r.p["max"], r.p.currency, r.p.period) for r in df.collect()}
    assert got == PAY


JOB = "id string, url string, alias_urls array<string>, title string, notes string, tags array<string>, updated_at int"
JOBS = [
    ("a", "https://x.org/1?utm_source=m", None, "", "mine", [], 5), ("b", "https://x.org/2", ["https://y.org/9"], "Engineer", "theirs", ["t"], 9), ("c", "https://www.x.org/1", None, "Other", None, None, 1),
    ("d", None, ["https://x.org/2#top", "not a url"], "D", None, None, 1), ("e", None, None, "E", None, None, 1), ("f", None, ["https://x.org/7"], "F", "same", None, 1), ("g", "https://x.org/7", None, None, " same ", None, 1),
]


def test_pairs_by_present_and_former_addresses(spark):
    jobs = spark.createDataFrame(JOBS, JOB)
    assert {tuple(r) for r in T.same_address(jobs).collect()} == {("c", "a"), ("d", "b"), ("g", "f")}
    assert {r.address: r.id for r in T.by_address(jobs).collect()}["https://x.org/1"] == "a"


def test_merge_is_one_operation(spark):
    jobs, letters = spark.createDataFrame(JOBS, JOB), spark.createDataFrame([("l1", "b"), ("l2", "a"), ("l3", None), ("l4", "g")], "id string, job_id string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("e", "e"), ("e", "zz"), ("f", "g")], "survivor string, absorbed string")
    records, moved = T.merged(jobs, letters, pairs)
    got = {r.id: r for r in records.collect()}
    assert set(got) == {"a", "c", "d", "e", "f"}
    a = got["a"]
    assert (a.url, a.alias_urls, a.title, a.notes, a.tags, a.updated_at) == ("https://x.org/1?utm_source=m", ["https://x.org/2", "https://y.org/9"], "Engineer", "mine\n\ntheirs", ["t"], 5)
    assert (got["f"].url, got["f"].alias_urls, got["f"].notes) == ("https://x.org/7", None, "same") and got["d"].alias_urls == JOBS[3][2]
    assert {tuple(r) for r in moved.collect()} == {("l1", "a"), ("l2", "a"), ("l3", None), ("l4", "f")}


def test_accepted_lines(spark):
    change = "array<struct<original:string,rewritten:string>>"
    rows = [(1, "a\nb\na\nc", [("a", "A"), ("a", None), ("z", "Z"), (None, "new")]), (2, None, [(None, "x")]), (3, "a", [("a", "b"), ("b", "c")]), (4, "a\nb", [])]
    df = spark.createDataFrame(rows, f"k int, t string, c {change}")
    assert {r.k: r.o for r in df.select("k", T.accepted_lines(F.col("t"), F.col("c")).alias("o")).collect()} == {1: "A\nb\nc\nnew", 2: "x", 3: "b", 4: "a\nb"}


def test_pay_places_are_found_once():
    """The matches of a text are found once for each pattern, not again for each match."""
    from sedgework.functions import pay as P

    assert str(P.pay(F.col("x"))).count("regexp_extract_all") == 3
