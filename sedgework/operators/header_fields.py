"""The parts of an entry's head as title, employer, place and team: a scored assignment, with a vote over the document.

A head's lines are cut at their separators. Each part has points for each field, from what it looks like and from where it stands;
the fields are given to the parts one to one so that the sum of points is largest. Documents keep one order: in a second round the
order that most heads of the document chose by their own evidence speaks for the others.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions import shapes as H
from sedgework.functions import values as V
from sedgework.operators.entries import once, sure

FIELDS = ("title", "company", "location", "team")
#: Points of a part for a field, in the order of FIELDS: by its looks, and by its place among the parts that look like nothing.
LOOKS = {"title": (40, -20, -30, 2), "company": (-20, 40, -30, 2), "place": (-40, -40, 60, -20), "none": (0, 0, -50, 1)}
ON_ANCHOR, ABOVE_ANCHOR = (-6, 9, 0, 0), (9, -6, 0, 0)
FIRST, SECOND = (5, 4, 0, 0), (4, 5, 0, 0)
VOTE = 8
MOST_PARTS = 6


def parts_of(lines: Column) -> Column:
    """The lines of a head as parts (text, line): cut at ``|``, ``·``, ``@`` and dashes between blanks, and at the comma behind a title."""
    cut = F.transform(lines, lambda h, i: F.transform(F.split(h, "\\s+@\\s+|\\s+[—–]\\s+|\\s+\\|\\s*|\\s*\\|\\s+|\\s+·\\s+"), lambda p: F.struct(F.trim(p).alias("text"), i.alias("line"))))

    def comma(p: Column) -> Column:
        head, tail = F.trim(F.substring_index(p["text"], ",", 1)), F.trim(F.regexp_replace(p["text"], "^[^,]*,", ""))
        splits = p["text"].contains(",") & ~H.is_bare_place(p["text"]) & (head != "") & (tail != "") & H.looks_like_title(head) & ~H.looks_like_title(tail) & ~tail.rlike("(?i)^(?:Inc|LLC|Ltd|Corp|GmbH)[.]?$")
        return F.when(splits, F.array(F.struct(head.alias("text"), p["line"].alias("line")), F.struct(tail.alias("text"), p["line"].alias("line")))).otherwise(F.array(p))

    return F.slice(F.filter(F.flatten(F.transform(F.flatten(cut), comma)), lambda p: p["text"] != ""), 1, MOST_PARTS)


def looks(text: Column) -> Column:
    """What a part looks like; an employer's word decides against a title, so each pattern is tried at most once."""
    named = F.when(H.has_word(text, V.COMPANY_WORDS), "company").when(H.has_word(text, V.TITLE_WORDS), "title").when(H.has_word(text, V.SCHOOL_WORDS), "company")
    return F.when(H.is_bare_place(text), "place").otherwise(named.otherwise("none"))


def points(parts: Column, kinds: Column, anchor: Column) -> Column:
    """For each part, of the ``kinds`` that they look like, its points for each field."""
    literal = lambda xs: F.array(*[F.lit(x) for x in xs])
    zero = literal((0,) * len(FIELDS))
    table = lambda kind: F.coalesce(*[F.when(kind == k, literal(v)) for k, v in LOOKS.items()])
    stacked = (anchor > 0) & F.exists(parts, lambda p: p["line"] < anchor)

    def one(p: Column, i: Column) -> Column:
        line = F.when(~stacked, zero).when(p["line"] == anchor, literal(ON_ANCHOR)).when(p["line"] < anchor, literal(ABOVE_ANCHOR)).otherwise(zero)
        place = F.when(i == 0, literal(FIRST)).when(i == 1, literal(SECOND)).otherwise(zero)
        return F.zip_with(F.zip_with(table(F.get(kinds, i)), line, lambda a, b: a + b), place, lambda a, b: a + b)

    return F.transform(parts, one)


def assigned(scores: Column, title_first: Column | None = None) -> Column:
    """The best assignment: for each field the number of its part, or -1, and the sum. Of equal ones the first in order.

    ``title_first`` is the document's order (null or not given: none): a title before (or behind) the employer gets the vote's points.
    """
    options = sorted(set(permutations([*range(MOST_PARTS), *[-1] * len(FIELDS)], len(FIELDS))), key=lambda p: [99 if x < 0 else x for x in p])
    # a part that isn't there is never given: only the assignments of as many parts as there are are tried, in the same order
    of_parts = [F.array(*[F.array(*map(F.lit, o)) for o in options if max(o) < n]) for n in range(MOST_PARTS + 1)]
    choices = reduce(lambda other, n: F.when(F.size(scores) == n, of_parts[n]).otherwise(other), range(MOST_PARTS), of_parts[MOST_PARTS])

    def total(o: Column) -> Column:
        fields = [F.coalesce(F.get(F.get(scores, o[k]), F.lit(k)), F.when(o[k] >= 0, -1000).otherwise(0)) for k in range(len(FIELDS))]
        points = reduce(lambda a, b: a + b, fields)
        if title_first is None:
            return points
        both = (o[0] >= 0) & (o[1] >= 0)
        return points + F.when(sure(both & (title_first == (o[0] < o[1]))), F.lit(VOTE)).otherwise(0)

    ranked = F.transform(choices, lambda o, i: F.struct(total(o).alias("sum"), (-i).alias("early"), o.alias("of")))
    return F.array_max(ranked)


def header_fields(heads: DataFrame, keys: list[str], entry: str = "entry") -> DataFrame:
    """``heads`` (keys of a document, entry, header_lines, anchor_index) with title, company, location, team.

    A document's order is that of most of its heads in which a title or an employer was known by its looks (ties: title first
    counts for neither). Parts beyond the sixth, and those that are left over, belong to no field. An equal employer and title are
    only a title. Heads without lines have no fields. Other columns stay.
    """
    rows = once(heads, __p=parts_of(F.coalesce("header_lines", F.array().cast("array<string>")))).drop(*FIELDS)
    rows = once(rows, __k=F.transform("__p", lambda p: looks(p["text"])))
    rows = once(rows, __s=points(F.col("__p"), F.col("__k"), F.coalesce("anchor_index", F.lit(-1))))
    rows = once(rows, __first=assigned(F.col("__s"))["of"])
    o = F.col("__first")
    both = (o[0] >= 0) & (o[1] >= 0)
    known = both & ((F.get("__k", o[0]) == "title") | (F.get("__k", o[1]) == "company"))
    ballot = F.when(sure(known), F.when(o[0] < o[1], 1).otherwise(-1))
    rows = rows.withColumn("__votes", F.sum(ballot).over(Window.partitionBy(*keys)))
    rows = rows.withColumn("__v", F.when(F.col("__votes") > 0, True).when(F.col("__votes") < 0, False)).drop("__votes")
    # a vote can only change heads that may be told both ways, and of these not those that go by it already: all that gain by it gain as much
    open_ = (F.size("__s") > 1) & F.col("__v").isNotNull() & ~(both & (F.col("__v") == (o[0] < o[1])))
    rows = once(rows, __a=F.when(open_, assigned(F.col("__s"), F.col("__v"))["of"]).otherwise(o))
    of = lambda k: F.get(F.col("__p"), F.when(F.col("__a")[k] >= 0, F.col("__a")[k]))["text"]
    rows = rows.withColumns({f: of(k) for k, f in enumerate(FIELDS)})
    return rows.withColumn("company", F.when(F.col("company") != F.col("title"), F.col("company")).when(F.col("title").isNull(), F.col("company"))).drop("__p", "__k", "__s", "__a", "__first", "__v")
