"""Gutters, grids and lines of pages: golden pages in one run, boundaries against a direct account."""

from __future__ import annotations

import random

import pytest

from sedgework.operators import columns as C

ITEMS = "doc string, page int, x double, y double, width double, font double, str string"


def words(rng, doc, page, kind):
    """A page's items: one column, two columns, or one column with a rail of dates."""
    out = []
    for r in range(30):
        y = 60.0 + 14 * r + rng.uniform(-1, 1)
        if kind == "two":
            out += [(doc, page, 50.0 + 40 * k, y, 36.0, 10.0, f"l{r}.{k}") for k in range(5)] + [(doc, page, 330.0 + 40 * k, y, 36.0, 10.0, f"r{r}.{k}") for k in range(4)]
        elif kind == "one":
            out += [(doc, page, 50.0 + 40 * k + rng.uniform(-3, 3), y, 38.0, 10.0, f"w{r}.{k}") for k in range(12)]
        else:
            out += [(doc, page, 50.0 + 40 * k, y, 38.0, 10.0, f"w{r}.{k}") for k in range(12 if r % 3 else 4)] + ([] if r % 3 else [(doc, page, 480.0, y, 60.0, 10.0, "2019 - 2020")])
    return out


def brute(items, width):
    """The split of one page, or None."""
    if len(items) < 30:
        return None
    rows: list[list] = []
    for it in sorted(items, key=lambda i: i[3]):
        if rows and it[3] - rows[-1][0][3] <= 3.5:
            rows[-1].append(it)
        else:
            rows.append([it])
    if len(rows) < 8:
        return None
    n = -int(-width // 3)
    seen = [0] * n
    for row in rows:
        for c in {c for it in row for c in range(max(0, int(it[2] // 3)), min(n - 1, int((it[2] + it[4]) // 3)) + 1)}:
            seen[c] += 1
    best, centre, run = 0, -1.0, 0
    for c in range(int(width * 0.2 // 3), min(-int(-(width * 0.8) // 3), n - 1) + 1):
        run = run + 1 if seen[c] / len(rows) <= 0.04 else 0
        if run > best:
            best, centre = run, (2 * c - run + 1) / 2
    if centre < 0 or best * 3 < width * 0.01:
        return None
    split = centre * 3
    left, right = (sum(any((it[2] < split) == side for it in row) for row in rows) for side in (True, False))
    return split if left >= 4 and right >= 4 else None


def test_boundaries_are_those_of_a_direct_account(spark):
    rng = random.Random(1)
    items, pages = [], []
    for d in range(24):
        kind = ("one", "two", "rail")[d % 3]
        width = (612.0, 595.0, 0.0)[d % 5 % 3]
        items += words(rng, f"{kind}{d}", 1, kind)
        pages.append((f"{kind}{d}", 1, width, 900))
    for d in range(30):  # random pages
        n = rng.randrange(10, 120)
        items += [(f"x{d}", 2, rng.choice((40.0, 60.0, 340.0, 420.0)) + rng.uniform(0, 30), rng.randrange(50, 700) * 1.0, rng.uniform(5, 160), 10.0, "w") for _ in range(n)]
        pages.append((f"x{d}", 2, 612.0, 900))
    got = {(r.doc, r.page): r.split for r in C.column_boundaries(spark.createDataFrame(items, ITEMS), spark.createDataFrame(pages, "doc string, page int, width double, chars int"), ["doc", "page"]).collect()}
    want = {}
    for doc, page, width, _ in pages:
        split = brute([i for i in items if i[0] == doc and i[1] == page], width or 612.0)
        if split is not None:
            want[doc, page] = split
    assert got == pytest.approx(want)
    assert {d[:3] for d, _ in want} >= {"two"} and not any(d.startswith(("one", "rail")) for d, _ in want) and sum(d.startswith("x") for d, _ in want) > 2


LINES = {
    "merge": [(50, 60, 30, "Data"), (85, 60, 40, "Engineer"), (50, 74.5, 20, "Ac"), (70, 75, 20, "me"), (400, 74, 80, "Jan 2019 - May 2021")],
    "cells": [(50, 60, 30, "Acme"), (300, 60, 40, "Berlin")],
    "grid": [(50, 40, 60, "Coursework"), *[(50 + 180 * c, 60 + 14 * r, 40, f"c{c}r{r}") for r in range(3) for c in range(3)], (50, 120, 60, "After")],
    "dates": [(50, 60, 30, "Acme"), (450, 60, 70, "2019 - 2020"), (50, 74, 30, "Globex"), (450, 74, 70, "2017 - 2018")],
    "letters": [(50, 60, 90, "J O R D A N"), (145, 60, 5, " "), (152, 60, 60, "Reyes"), (50, 74, 10, None)],
}
WANT = {
    "merge": ["Data Engineer", "Acme Jan 2019 - May 2021"],
    "cells": ["Acme", "Berlin"],
    "grid": ["Coursework", "c0r0", "c0r1", "c0r2", "c1r0", "c1r1", "c1r2", "c2r0", "c2r1", "c2r2", "After"],
    "dates": ["Acme 2019 - 2020", "Globex 2017 - 2018"],
    "letters": ["JORDAN Reyes", ""],
    "banded": ["left one", "left two", "right one", "right two", "next page"],
}


def test_lines_in_reading_order(spark):
    rows = [(d, 1, float(x), float(y), float(w), 10.0, s) for d, items in LINES.items() for x, y, w, s in items]
    rows += [("banded", 1, 50.0, 60.0, 80.0, 10.0, "left one"), ("banded", 1, 330.0, 60.0, 80.0, 10.0, "right one"), ("banded", 1, 50.0, 74.0, 80.0, 10.0, "left two"), ("banded", 1, 330.0, 80.0, 80.0, 12.0, "right two"), ("banded", 2, 50.0, 10.0, 80.0, 10.0, "next page")]
    got = C.lines(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([("banded", 1, 200.0)], "doc string, page int, split double"), ["doc"]).orderBy("doc", "ord").collect()
    assert {d: [r.text for r in got if r.doc == d] for d in WANT} == WANT
    assert [(r.ord, r.band, r.gap, r.font) for r in got if r.doc == "banded"] == [(0, 0, 0.0, 10.0), (1, 0, 14.0, 10.0), (2, 1, 0.0, 10.0), (3, 1, 20.0, 12.0), (4, 0, 0.0, 10.0)]


def test_flush_right_trailers_and_layout(spark):
    rows = [("a", 1, 50.0, 0.0, 60.0, 10.0, "Software Developer"), ("a", 1, 110.0, 0.0, 300.0, 10.0, " "), ("a", 1, 410.0, 0.0, 40.0, 10.0, "Remote"), ("b", 1, 50.0, 0.0, 60.0, 10.0, "x"), ("b", 1, 110.0, 0.0, 300.0, 10.0, " ")]
    assert [tuple(r) for r in C.flush_right(spark.createDataFrame(rows, ITEMS), ["doc", "page"]).collect()] == [("a", 1, "Software Developer", "Remote")]
    pages = spark.createDataFrame([("a", 1, 900), ("a", 2, 20), ("b", 1, 3), ("c", 1, 500), (None, 1, None)], "doc string, page int, chars int")
    got = {r.doc: (r.scanned, r.two_column, r.triggers) for r in C.layout(pages, spark.createDataFrame([("a", 2, 300.0), ("b", 1, 3.0)], "doc string, page int, split double"), ["doc"]).collect()}
    assert got == {"a": (False, True, ["two_column"]), "b": (True, False, ["scanned"]), "c": (False, False, []), None: (True, False, ["scanned"])}


def test_items_are_dealt_once(spark):
    """Words are dealt with their texts, before they are parted: no join of items, and at most one shuffle of them."""
    from sedgework import queries

    for name, most in (("column_boundaries", 1), ("page_layouts", 4), ("page_lines", 3)):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most
        assert name == "page_layouts" or "Join" not in plan


def test_lines_are_made_of_rows(spark):
    """Items become rows before anything is windowed: windows, sorts and the shuffle by document never see an item."""
    from sedgework import queries

    plan = queries.QUERIES["page_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert plan.executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2
    logical = plan.optimizedPlan().toString()
    first = logical[: logical.index("page_rows")]
    assert "Window" in first and "Window" not in logical[len(first) :] and "RepartitionByExpression" in first and ".items" not in first.split("RepartitionByExpression")[0]


def brute_lines(items):
    """The texts of one page of one column, by a walk over its rows."""
    rows, out = [], []
    for it in sorted(items, key=lambda i: i[1]):
        if rows and it[1] - rows[-1][0][1] <= 3.5:
            rows[-1].append(it)
        else:
            rows.append([it])
    cut = []
    for row in rows:
        row.sort(key=lambda i: (i[0], i[3], i[2]))
        cells, last = [], None
        for x, _, width, text in row:
            if last is None or x - last[0] - last[2] > 50:
                cells.append([])
            apart = last is not None and x - last[0] - last[2] > last[2] / max(len(last[3]), 1) * 0.4 and not last[3].endswith(" ") and not text.startswith(" ")
            cells[-1].append((x, " " * apart + text))
            last = (x, 0, width, text)
        cut.append(cells)
    k = 0
    while k < len(cut):
        end = k + 1
        while len(cut[k]) > 1 and end < len(cut) and len(cut[end]) > 1:
            end += 1
        if end - k < 2:
            out += [[t for _, t in cell] for cell in cut[k]]
        else:
            xs = sorted(x for row in cut[k:end] for cell in row for x, _ in cell)
            starts = [b for a, b in zip(xs, xs[1:], strict=False) if b - a > 50]
            keyed = [((sum(s <= x for s in starts), r, c), t) for r, row in enumerate(cut[k:end]) for c, cell in enumerate(row) for x, t in cell]
            out += [[t for key, t in keyed if key == z] for z in sorted({key for key, _ in keyed})]
        k = end
    return [" ".join("".join(parts).split()) for parts in out]


def test_lines_of_random_pages(spark):
    """Grids, wide gaps, blanks at ends and empty items against a walk over the rows."""
    rng = random.Random(5)
    pages = {f"p{d}": [(rng.choice((40.0, 130.0, 260.0, 420.0)) + rng.randrange(0, 60), rng.randrange(0, 8) * 14.0 + rng.choice((0.0, 1.5, 3.5)), float(rng.randrange(0, 70)), rng.choice(("ab", " c", "d ", "", "two words", "x"))) for _ in range(rng.randrange(1, 29))] for d in range(60)}
    rows = [(d, 1, x, y, w, 10.0, s) for d, items in pages.items() for x, y, w, s in items]
    found = C.lines(spark.createDataFrame(rows, ITEMS), None, ["doc"]).orderBy("doc", "ord").collect()
    assert {d: [r.text for r in found if r.doc == d] for d in pages} == {d: brute_lines(items) for d, items in pages.items()}
