"""Nearest records and values in lines against brute force; contact data by golden cases."""

from __future__ import annotations

import random
from itertools import combinations

from sedgework.operators import contacts as C
from sedgework.operators import nearest as N


def test_nearest_is_brute_force(spark):
    rng = random.Random(7)
    axes = {"a": 2, "b": 1, "c": 1, "d": 3}
    rows = [(k, *[rng.choice((None, 0, 1, 2, 3, 4)) if rng.random() < 0.7 else 0 for _ in axes]) for k in range(150)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c int, d int")
    sets = [s for n in range(1, 5) for s in combinations(axes, n) if sum(axes[x] for x in s) >= 3]
    want = {}
    for q in rows[::2]:
        best = None
        for r in rows:
            if r[0] == q[0]:
                continue
            same = {x for i, x in enumerate(axes, 1) if q[i] is not None and q[i] == r[i]}
            for i, s in enumerate(sets):
                if set(s) <= same:
                    best = max(best or (-1, 0, 0), (sum(axes[x] for x in s), -i, -r[0]))
        if best and best[0] >= 0:
            want[q[0]] = (-best[2], best[0], list(sets[-best[1]]))
    got = {r.id: (r.nearest, r.weight, r.agreed) for r in N.nearest_records(df.where("id % 2 = 0"), df, axes, 3).collect()}
    assert got == want and len(want) > 50


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_localized_is_brute_force(spark):
    rng = random.Random(3)
    words = ["acme", "data", "engineer", "berlin", "labs", "x", "of", "northwind", "retail"]
    lines = [(d, i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for d in range(30) for i in range(6)] + [(99, 0, None)]
    values = []
    for d in range(30):
        for f in range(4):
            v = list(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))))
            for _ in range(rng.randrange(0, 3)):
                v[rng.randrange(len(v))] = rng.choice("abcxyz")
            values.append((d, f"f{f}", "".join(v)))
    values += [(99, "f", "acme"), (1, "f9", None), (1, "f8", " ")]
    want = {}
    for d, f, v in values:
        low = " ".join((v or "").lower().split())
        hits = []
        for e, i, t in lines:
            w = (t or "").split()
            if e == d and w and low:
                n = len(low.split(" "))
                hits += [(distance(low, " ".join(w[k : k + n])), i, k, " ".join(w[k : k + n])) for k in range(max(1, len(w) - n + 1))]
        hits = [h for h in hits if h[0] <= 2]
        if hits:
            want[d, f, v] = min(hits)
    got = {(r.d, r.field, r.value): (r.distance, r.ord, r["at"], r.said) for r in N.localized(spark.createDataFrame(values, "d int, field string, value string"), spark.createDataFrame(lines, "d int, ord int, text string"), "d").collect()}
    assert got == want and len(want) > 40


def test_contacts(spark):
    docs = {
        "a": ["Jane Doe", "jane@x.org | +1 (555) 123-4567 | Austin, TX", "linkedin.com/in/jane · github.com/jane · https://jane.dev/blog", "see acme.com in prose for more"],
        "b": ["No data here", None], "c": ["me@y.co", "other@z.org", "Berlin, Germany"],
    }
    df = spark.createDataFrame([(k, i, t) for k, v in docs.items() for i, t in enumerate(v)], "k string, ord int, text string")
    got = {r.k: tuple(r)[1:] for r in C.contacts(df, ["k"]).collect()}
    assert got["a"] == ("jane@x.org", "+1 (555) 123-4567", "linkedin.com/in/jane", "github.com/jane", ["https://jane.dev/blog"], "Austin, TX", [1, 2])
    assert got["b"] == (None, None, None, None, [], None, []) and got["c"] == ("me@y.co", None, None, None, [], "Berlin, Germany", [0, 1, 2])


def test_nearest_broadcasts_no_sets(spark):
    """The sets of a small file's rows are many more than its bytes foretell: they are not sent through the driver."""
    df = spark.createDataFrame([(i, f"n{i % 5}", f"b{i % 3}") for i in range(30)], "id long, a string, b string")
    found = N.nearest_records(df.where("id % 2 = 0"), df, {"a": 2, "b": 1}, 2)
    assert found.count() == 15 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
