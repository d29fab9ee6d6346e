"""Entries of sections: golden cases, sections beside one another, odd rows."""

from __future__ import annotations

from collections import Counter

import pytest

from sedgework.operators import entries as E


def case(rows, want=None, step=0.0):
    """A section given as texts or (text, x) or (text, x, y), and what its entries are opened by."""
    full = [(r,) if isinstance(r, str) or r is None else r for r in rows]
    return [(i, r[0], float(r[1]) if len(r) > 1 else 72.0, float(r[2]) if len(r) > 2 else float(step * i)) for i, r in enumerate(full)], want or E.Entries()


def case(rows, want=None, step=0.0):
    """A section given as texts or (text, x) or (text, x, y), and what its entries are opened by."""
    full = [(r,) if isinstance(r, str) or r is None else r for r in rows]
    return [(i, r[0], float(r[1]) if len(r) > 1 else 72.0, float(r[2]) if len(r) > 2 else float(step * i)) for i, r in enumerate(full)], want or E.Entries()


SHAPES = [["Acme 2019 - 2020", "• Built it."], ["Boss", "Globex 01/2020 - Present", "• a", "• b"], ["plain"], ["X · Y  2021", "text. More text follows here and so it goes on.", "• c"]]
SHAPES = [["Acme 2019 - 2020", "• Built it."], ["Boss", "Globex 01/2020 - Present", "• a", "• b"], ["plain"], ["X · Y  2021", "text. More text follows here and so it goes on.", "• c"]]
CASES = {
    "head above a dated anchor and its bullets": case(["Senior Engineer", "Acme Corp  01/2020 - 03/2023", "• Cut p99 latency 40% via a new service mesh.", "• Mentored 6 engineers."], step=14),
    "each dated line opens an entry and bullets stay with theirs": case(["Acme Corp  01/2020 - 03/2023", "• First role bullet one.", "• First role bullet two.", "Globex Inc  06/2016 - Present", "• Second role bullet."], step=14),
    "no range no entry": case(["Acme Corp", "Senior Engineer", "• Did things"]),
    "no range no entry 2": case([]),
    "no range no entry 3": case([None, "", "   "]),
    "without lookback and without body": case(["Senior Engineer", "Acme Corp  01/2020 - 03/2023", "• A bullet."], E.Entries(lookback=0), step=14),
    "without lookback and without body 2": case(["Senior Engineer", "Acme Corp  01/2020 - 03/2023", "• A bullet."], E.Entries(body=False), step=14),
    "a wrapped tail is no head of the next entry": case([("Northwind Labs  Jul 2025 - Present", 50), ("• Documented architecture with peer", 64), ("review.", 90), ("Riverton County Schools  Oct 2025 - Present", 50), ("Substitute Teacher", 50), ("• Supported instruction.", 64)]),
    "an undated role opens an entry of its own": case([("Acme 2019 - 2021", 50), ("• Built it.", 64), ("Early Career: Acme Labs", 50), ("Analyst", 50), ("• Counted beans.", 64)]),
    "an undated role opens an entry of its own 2": case(["Acme 2019 - 2021", "• Reported to", "Senior Leadership on strategy", "• Counted beans."]),
    "an undated role opens an entry of its own 3": case(["Acme 2019 - 2021", "• Reported", "and social change", "• Counted beans."]),
    "a wrapped head is put together": case([("Docent | Community Heritage   May 2023 - June", 50), ("Museum", 50), ("2024", 400), ("• Led tours.", 64)]),
    "a wrapped head is put together 2": case([("Founding Team Lead ·   Mar. 2021 – Jun. 2023", 50), ("Marina Pay Inc., Seoul", 80), ("• Led it.", 64)]),
    "a wrapped head is put together 3": case([("Founding Team Lead  Mar. 2021 – Jun. 2023", 50), ("Marina Pay Inc.", 50), ("• Led it.", 64)]),
    "places and blanks cost no lookback": case(["Acme 2019 - 2020", "• Built it.", "Globex", "Engineer", "", "", "Bellevue, WA", "Jan 2021 - May 2022", "• Ran it."]),
    "running heads go": case(["Acme 2019 - 2020", "• Built it.", "Jane Smith · Résumé 2", "Globex 2021 - 2022", "• Ran it."]),
    "running heads go 2": case(["Resume Parser | Python, React  Jan 2024 - Present", "• Built it."]),
    "scope between date and bullets": case(["Director, Acme  2019 - 2021", "Founding site leader; owned charter and", "headcount.", "Berlin", "• Hired."], step=14),
    "scope between date and bullets 2": case(["Director, Acme  2019 - 2021  Owned charter; led 18 engineers.", "• Hired."]),
    "a body without marks is found by its indent": case([("Acme", 50, 0), ("Engineer  2019 - 2021", 50, 14), ("Designed the parser", 70, 28), ("and its tests", 70, 42), ("Reviewed the code", 70, 56), ("Globex", 50, 84), ("Analyst  2017 - 2019", 50, 98), ("Counted beans", 70, 112)]),
    "first line anchors": case(["Linter", "React, TypeScript, Vite", "• Built the cascade.", "Trip Planner  2024 - 2025", "• Added the view."], E.Entries("first_line", 0), step=14),
    "first line anchors 2": case(["Review Studio", "React, Tailwind", "Built a client-side review platform with feedback.", "Optimized rendering.", "Ledger Toolkit", "Java, Kafka", "Designed a teaching harness."], E.Entries("first_line", 0), step=14),
    "a list of bullets is a list of entries": case([("• Best Paper Award, 2021", 50), ("– with two others", 80), ("of the lab", 95), ("• Hackathon prize", 50), ("2019", 70)], E.Entries("first_line", 0)),
    "dates of titles stay where only dated anchors are read": case(["Acme  2019 - 2021", "• Built it.", "Software Engineer Intern Summer 2022", "• Tested it."], E.Entries(dated_only=True)),
    "dates of titles stay where only dated anchors are read 2": case(["Acme  2019 - 2021", "• Built it.", "Software Engineer Intern Summer 2022", "• Tested it."], E.Entries(dated_only=True)),
    "dates of titles stay where only dated anchors are read 3": case(["Engineer · Acme  2022", "• Tested it."], E.Entries(dated_only=True)),
    "institutions": case(["Northern College", "BSc, 2019", "Harbour University  2014 - 2016", "• Thesis"], E.Entries("institution", 0)),
    **{f"shape {k}": case([(t, 0, 0) for t in lines]) for k, lines in enumerate(SHAPES)},
}


@pytest.fixture(scope="module")
def found(spark):
    """The entries of all cases, computed together for each setting."""
    out = {n: [] for n in CASES}
    for setting in {want for _, want in CASES.values()}:
        rows = [(n, *line) for n, (lines, want) in CASES.items() if want == setting for line in lines]
        df = spark.createDataFrame(rows, "k string, ord int, text string, x double, y double")
        for r in E.entry_blocks(df, ["k"], setting).orderBy("k", "entry").collect():
            out[r.k].append(r)
    return out


def test_head_above_a_dated_anchor_and_its_bullets(found):
    [b] = found["head above a dated anchor and its bullets"]
    assert b.header_lines == ["Senior Engineer", "Acme Corp"] and b.anchor_index == 1
    assert (b.start, b.end, b.current, b.bullets) == ("01/2020", "03/2023", False, 2)
    assert b.body == "Cut p99 latency 40% via a new service mesh.\nMentored 6 engineers."


def test_each_dated_line_opens_an_entry_and_bullets_stay_with_theirs(found):
    a, b = found["each dated line opens an entry and bullets stay with theirs"]
    assert a.header_lines == ["Acme Corp"] and a.bullets == 2
    assert b.header_lines == ["Globex Inc"] and b.body == "Second role bullet." and b.current and b.end is None


def test_no_range_no_entry(found):
    assert found["no range no entry"] == []
    assert found["no range no entry 2"] == []
    assert found["no range no entry 3"] == []


def test_without_lookback_and_without_body(found):
    [b] = found["without lookback and without body"]
    assert b.header_lines == ["Acme Corp"]
    [b] = found["without lookback and without body 2"]
    assert b.body is None and b.bullets == 0


def test_a_wrapped_tail_is_no_head_of_the_next_entry(found):
    a, b = found["a wrapped tail is no head of the next entry"]
    assert a.body == "Documented architecture with peer review." and a.bullets == 1
    assert b.header_lines == ["Riverton County Schools", "Substitute Teacher"] and b.below == ["Substitute Teacher"]


def test_an_undated_role_opens_an_entry_of_its_own(found):
    a, b = found["an undated role opens an entry of its own"]
    assert b.header_lines == ["Early Career: Acme Labs", "Analyst"] and b.start is None and b.body == "Counted beans."
    # a bullet that ends in a connective runs on; prose and lower case are no heads
    assert len(found["an undated role opens an entry of its own 2"]) == 1
    assert len(found["an undated role opens an entry of its own 3"]) == 1


def test_a_wrapped_head_is_put_together(found):
    [b] = found["a wrapped head is put together"]
    assert b.header_lines == ["Docent | Community Heritage Museum"] and (b.start, b.end) == ("May 2023", "June 2024")
    [b] = found["a wrapped head is put together 2"]
    assert b.header_lines == ["Founding Team Lead · Marina Pay Inc., Seoul"] and b.end == "Jun. 2023"
    # at the margin a second line stays a line
    [b] = found["a wrapped head is put together 3"]
    assert b.header_lines == ["Founding Team Lead", "Marina Pay Inc."]


def test_places_and_blanks_cost_no_lookback(found):
    a, b = found["places and blanks cost no lookback"]
    assert a.body == "Built it."
    assert b.header_lines == ["Globex", "Engineer"] and b.anchor_index == -1


def test_running_heads_go(found):
    a, b = found["running heads go"]
    assert b.header_lines == ["Globex"]
    [p] = found["running heads go 2"]
    assert p.header_lines == ["Resume Parser | Python, React"]


def test_scope_between_date_and_bullets(found):
    [b] = found["scope between date and bullets"]
    assert b.scope == ["Founding site leader; owned charter and headcount."] and b.header_lines == ["Director, Acme", "Berlin"]
    [b] = found["scope between date and bullets 2"]
    assert b.header_lines == ["Director, Acme"] and b.scope == ["Owned charter; led 18 engineers."]


def test_a_body_without_marks_is_found_by_its_indent(found):
    a, b = found["a body without marks is found by its indent"]
    assert a.header_lines == ["Acme", "Engineer"] and a.body == "Designed the parser and its tests\nReviewed the code"
    assert b.header_lines == ["Globex", "Analyst"] and b.body == "Counted beans"


def test_first_line_anchors(found):
    a, b = found["first line anchors"]
    assert a.header_lines == ["Linter", "React, TypeScript, Vite"] and a.start is None
    assert b.header_lines == ["Trip Planner"] and (b.start, b.end) == ("2024", "2025")
    a, b = found["first line anchors 2"]
    assert a.header_lines == ["Review Studio", "React, Tailwind"] and b.header_lines == ["Ledger Toolkit", "Java, Kafka"]
    assert "review platform" in a.body and b.body == "Designed a teaching harness."


def test_a_list_of_bullets_is_a_list_of_entries(found):
    a, b = found["a list of bullets is a list of entries"]
    assert a.header_lines == ["Best Paper Award"] and a.start == "2021" and a.separator == "," and a.body == "with two others of the lab" and a.anchor_index is None
    assert b.header_lines == ["Hackathon prize"] and b.start == "2019" and b.body is None


def test_dates_of_titles_stay_where_only_dated_anchors_are_read(found):
    assert found["dates of titles stay where only dated anchors are read"][1].header_lines == ["Software Engineer Intern Summer 2022"]
    assert found["dates of titles stay where only dated anchors are read 2"][1].start is None
    [b] = found["dates of titles stay where only dated anchors are read 3"]
    assert b.start == "2022" and b.header_lines == ["Engineer · Acme"]


def test_institutions(found):
    a, b = found["institutions"]
    assert a.header_lines == ["Northern College", "BSc, 2019"] and b.start == "2014" and b.bullets == 1


@pytest.mark.parametrize("n", [40])
def test_sections_are_apart_and_every_anchor_is_one_entry(spark, found, n):
    """Many sections at once give what each gives alone, null keys too."""
    rows = [(k if k else None, i, t, 0.0, 0.0) for k in range(n) for i, t in enumerate(SHAPES[k % 4])]
    got = E.entry_blocks(spark.createDataFrame(rows, "k int, ord int, text string, x double, y double"), ["k"]).collect()
    assert Counter(r.k for r in got) == Counter(k if k else None for k in range(n) if k % 4 != 2)
    for s in range(4):
        alone = found[f"shape {s}"]
        assert all(list(r[1:]) == list(alone[0][1:]) for r in got if (r.k or 0) % 4 == s)


def test_wrapped_lines_are_put_to_theirs(spark):
    rows = [("k", i, t, float(x), 0.0) for i, (t, x) in enumerate([("Acme", 50), ("• Built a long ", 64), ("  and winding road", 90), ("• Ran it", 64), ("Place", 50)])]
    got = E.without_wraps(spark.createDataFrame(rows, "k string, ord int, text string, x double, y double"), ["k"]).orderBy("ord").collect()
    assert [r.text for r in got] == ["Acme", "• Built a long and winding road", "• Ran it", "Place"]
