"""Entries of a section: the lines of a section parted into blocks of head, dates and body.

A section's lines (text, x, y, in order) are rows; what opens an entry (an anchor) is decided from a line and
its neighbours, and all windows of an entry (head lines above its anchor, below it, its body) are running
aggregates over the lines between two anchors. A section is the unit of every window and stays in one task;
sections are spread. ``x`` and ``y`` may be all equal (plain text), which switches off the rules that need them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions import dates as T
from sedgework.functions import shapes as H
from sedgework.functions import values as V


@dataclass(frozen=True)
class Entries:
    """``anchor``: what opens an entry, a ``date_range``, an ``institution`` or the ``first_line`` behind a body.

    ``lookback``: how many lines above an anchor may belong to its head. ``dated_only``: dates are read off anchors
    that have a range (or end in a year), not off other lines. ``body``: whether bullets are collected.
    """

    anchor: str = "date_range"
    lookback: int = 2
    dated_only: bool = False
    body: bool = True


DATE_START = f"(?i){V.LOOSE_MONTH_YEAR}|{V.NUMERIC_MONTH_YEAR}|{V.BARE_YEAR}"


def sure(x: Column) -> Column:
    """True where a condition holds, false where it doesn't or is null."""
    return F.coalesce(x, F.lit(False))


def is_bullet(text: Column) -> Column:
    return text.rlike(V.LINE_BULLET)


def without_bullet(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{V.LINE_BULLET}\\s*", ""))


def has_range(text: Column) -> Column:
    return T.has_date_range(text) | text.rlike(V.OPEN_WORD)


def is_place(text: Column) -> Column:
    return F.trim(text).rlike(V.PLACE_LINE)


def is_paragraph(text: Column) -> Column:
    """A sentence's end, a long line, or a verb first; commas speak for a list."""
    t = F.trim(text)
    return (t != "") & (t.rlike("[.!?]$") | (~t.contains(",") & ((F.length(t) > V.PARAGRAPH_CHARS) | t.rlike(V.PARAGRAPH_VERB))))


def is_dated(text: Column) -> Column:
    """A range, or a head with a middle dot that ends in a year; bullets are never dated."""
    year = text.contains("·") & F.trim(text).rlike("(?:^|\\s)(?:19|20)[0-9]{2}$") & H.is_entry_header(text)
    return ~is_bullet(text) & (has_range(text) | year)


def is_running_head(text: Column) -> Column:
    return H.is_page_furniture(text) & text.rlike(V.RUNNING_HEAD)


def has_more(text: Column) -> Column:
    """Whether words are left of a line without its dates: one with a range opens an entry by itself."""
    return F.trim(F.regexp_replace(T.without_dates(text), V.OPEN_WORD, "")) != ""


def margins(rows: DataFrame, keys: list[str], counts: Column | None = None) -> DataFrame:
    """Add bullet, marker (the bullets' margin, null without any) and wrapped (a line right of it without a bullet); only lines that count are bullets."""
    rows = rows.withColumn("bullet", is_bullet(F.col("text")) & (F.lit(True) if counts is None else counts)).withColumn("marker", F.min(F.when(F.col("bullet"), F.col("x"))).over(Window.partitionBy(*keys)))
    return rows.withColumn("wrapped", ~F.col("bullet") & sure(F.col("x") > F.col("marker") + V.MARGIN))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with further columns that are computed once, however often they are used (the fields of the only element of an array)."""
    return rows.withColumn("__once", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))).select("*", "__once.*").drop("__once")


def unwrapped_heads(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Heads whose date or employer runs on in the next lines, put together: rows (keys, ord, text, x, y) again.

    A line with a date that is no range yet takes up to ``most`` lines, if a range comes out: those of the date column go
    behind the date, others before it. A line with a whole range takes the lines that are set in below it, in one-column
    sections. Lines are taken in order: a line that was taken takes none.
    """
    order = Window.partitionBy(*keys).orderBy("ord")
    all_ = Window.partitionBy(*keys)
    text = F.col("text")
    t = F.trim(text)
    # what is read off a line alone is computed once, and not for bullets, which neither take lines nor are taken; dates have digits
    rows = once(rows, free=~is_bullet(text))
    rows = once(rows, whole=F.when(F.col("free"), has_range(text)), before=F.when(F.col("free") & text.rlike("[0-9]"), T.before(text, DATE_START)), year=t.rlike("^(?:[0-9]{4}|'[0-9]{2})$"))
    rows = once(rows, more=F.col("free") & ~(F.col("whole") & has_more(text)))
    rows = margins(rows, keys).withColumn("narrow", F.max("x").over(all_) - F.min("x").over(all_) <= V.COLUMN_SPREAD)
    rows = rows.withColumns({"lead": F.trim("before"), "date": F.trim(F.substring(text, F.length("before") + 1, F.length(text))), "right": F.col("wrapped") | F.col("year") | F.col("whole")})
    ahead = [{c: F.lead(c, k).over(order) for c in ("more", "wrapped", "right", "text")} for k in range(1, most + 1)]
    loose = [sure(a["more"]) for a in ahead]
    tight = [ok & sure(a["wrapped"]) & sure(F.trim(a["text"]) != "") for ok, a in zip(loose, ahead, strict=True)]
    run = lambda oks: reduce(lambda x, y: x + y, [reduce(lambda p, q: p & q, oks[: k + 1]).cast("int") for k in range(most)])
    rows = rows.withColumns({"n_loose": run(loose), "n_tight": run(tight)} | {f"t{k}": F.trim(a["text"]) for k, a in enumerate(ahead, 1)} | {f"r{k}": a["right"] for k, a in enumerate(ahead, 1)})
    taken = lambda n, side: [F.when((F.col(n) >= k) & (F.lit(True) if side is None else F.col(f"r{k}") == side), T.some(F.col(f"t{k}"))) for k in range(1, most + 1)]
    loose_text = T.spaced(F.concat_ws(" ", T.some(F.col("lead")), *taken("n_loose", False), T.some(F.col("date")), *taken("n_loose", True)))
    tight_text = T.spaced(F.concat_ws(" ", T.some(F.col("lead")), *taken("n_tight", None), T.some(F.col("date"))))
    dated = ~F.col("bullet") & F.col("lead").isNotNull()
    rows = once(rows, loose=F.when(dated & ~F.col("whole") & (F.col("n_loose") > 0), loose_text))
    rows = once(rows, complete=sure(has_range(F.col("loose"))))
    completes, loose_text = F.col("complete"), F.col("loose")
    extends = dated & F.col("whole") & (F.col("lead") != "") & F.col("narrow") & (F.col("n_tight") > 0)
    rows = rows.withColumn("k", F.when(completes, F.col("n_loose")).when(extends, F.col("n_tight")).otherwise(0))
    rows = rows.withColumn("text", F.when(completes, loose_text).when(extends, tight_text).otherwise(text)).select(*keys, "ord", "text", "x", "y", "k")
    # which lines are left: a running count of lines that still belong to the last one that took some
    start = F.struct(F.lit(0).alias("left"), F.lit("").alias("out"))
    step = lambda s, e: F.struct(F.when(s["left"] > 0, s["left"] - 1).otherwise(e["k"]).alias("left"), F.concat(s["out"], F.when(s["left"] > 0, "0").otherwise("1")).alias("out"))
    whole = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "k", "text", "x", "y"))).alias("lines"))
    kept = F.split(F.aggregate("lines", start, step, lambda s: s["out"]), "(?!^)(?!$)")
    marked = F.when(F.exists("lines", lambda e: e["k"] > 0), kept)
    each = whole.select(*keys, F.explode(F.arrays_zip("lines", F.coalesce(marked, F.array().cast("array<string>")).alias("kept"))).alias("m"))
    return each.where(F.coalesce(F.col("m.kept"), F.lit("1")) == "1").select(*keys, "m.lines.ord", "m.lines.text", "m.lines.x", "m.lines.y")


def anchored(rows: DataFrame, keys: list[str], want: Entries) -> DataFrame:
    """Add anchor, and what the windows need: baseline, margin (of a body without bullets), shapes of a line, its neighbours' places."""
    part = Window.partitionBy(*keys)
    order = part.orderBy("ord")
    above, below = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    text = F.col("text")
    shapes = {"dated": is_dated(text), "head": H.is_entry_header(text), "prose": ~is_bullet(text) & H.is_prose(text), "place": is_place(text), "blank": F.trim(text) == ""}
    if want.anchor == "institution":
        shapes["school"] = H.has_word(text, V.SCHOOL_WORDS)
    elif want.anchor != "date_range":
        shapes["paragraph"] = is_paragraph(text)
    rows = once(rows, **shapes)
    rows = margins(rows, keys).withColumns({"i": F.row_number().over(order) - 1, "y_above": F.lag("y").over(order), "y_below": F.lead("y").over(order), "above": F.lag("text").over(order)})
    rows = rows.withColumn("baseline", F.coalesce(F.median(F.when(F.col("y") > F.col("y_above"), F.col("y") - F.col("y_above"))).over(part), F.lit(0.0)))
    if want.anchor == "date_range":
        after_body = sure(F.last(F.when(~F.col("wrapped"), F.col("bullet")), ignorenulls=True).over(above))
        next_bullet, next_date = (F.min(F.when(F.col(c), F.col("i"))).over(below) for c in ("bullet", "dated"))
        has_body = next_bullet.isNotNull() & (next_date.isNull() | (next_bullet < next_date))
        undated = ~F.col("bullet") & ~F.col("dated") & after_body & ~F.trim("above").rlike(V.DANGLING_END) & ~F.col("wrapped") & F.col("head") & has_body
        anchor = F.col("dated") | (F.max("dated").over(part) & sure(undated))
    elif want.anchor == "institution":
        anchor = F.col("school")
    else:
        free, level = ~F.col("bullet"), F.coalesce(F.col("x") <= F.col("marker"), F.lit(True))
        continues = F.lag(free & level).over(order) & ~(F.lag("paragraph").over(order) & F.col("head") & ~F.col("paragraph"))
        anchor = free & ((F.col("i") == 0) | (level & ~sure(continues)))
    rows = rows.withColumn("anchor", anchor)
    edge = F.min(F.when(F.col("anchor"), F.col("x"))).over(part)
    rows = rows.withColumn("edge", F.when(F.col("marker").isNull() & F.lit(want.anchor == "date_range"), edge))
    rows = rows.withColumn("margin", F.min(F.when(F.col("x") > F.col("edge") + V.MARGIN, F.col("x"))).over(part))
    return rows.withColumn("set_in", sure(F.col("x") >= F.col("margin") - V.MARGIN))


def texts_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """The texts of a unit's lines, in order, joined by blanks."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("i", "part"))), lambda s: s["part"])
    return rows.groupBy(*by).agg(F.array_join(parts, " ").alias("part"))


def entry_blocks(lines: DataFrame, keys: list[str], want: Entries | None = None) -> DataFrame:
    """The entries of each section (``keys``) of ``lines`` (ord, text, x, y).

    Returns the keys, entry (from 0), ord (of its anchor), header_lines, anchor_index (of the anchor's own text among them; -1
    if nothing of it is left, null in a list of bullets), start, end, current, separator (before the date), body (units by line
    ends, null if none), bullets (units), scope (text between date and body), below (head lines under the anchor). A section
    without an anchor has no entry, but with ``first_line`` each bullet of the outer level is one. Null texts are blank lines.
    """
    want = want or Entries()
    given, keys = keys, [f"__k{i}" for i in range(len(keys))]  # keys may be called as anything here is
    rows = lines.select(*[F.col(g).alias(k) for g, k in zip(given, keys, strict=True)], "ord", F.coalesce("text", F.lit("")).alias("text"), "x", "y").where(~is_running_head(F.coalesce("text", F.lit(""))))
    if want.anchor == "date_range":
        rows = unwrapped_heads(rows, keys, want.lookback or 2)
    rows = anchored(rows, keys, want)
    part = Window.partitionBy(*keys)
    order = part.orderBy("i")
    rows = rows.withColumn("some", F.max("anchor").over(part))
    listed = rows.where(~F.col("some") & F.col("marker").isNotNull()) if want.anchor == "first_line" else None
    rows = rows.where("some").withColumns({"entry": F.sum(F.col("anchor").cast("int")).over(order) - 1, "nxt": F.min(F.when(F.col("anchor"), F.col("i"))).over(order.rowsBetween(1, Window.unboundedFollowing))})
    stops = F.col("bullet") | F.col("prose") | F.col("set_in")
    gap = V.PARAGRAPH_GAP * F.col("baseline")
    spaced = F.col("baseline") > 0
    near = lambda last: sure(spaced & (F.col("y") > last) & (F.col("y") - last <= gap))

    # upwards from an anchor: its own head lines, and where the window of the entry before it ends
    up = Window.partitionBy(*keys, "nxt").orderBy(F.desc("i"))
    lower, upto = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.unboundedPreceding, 0)
    free = F.col("blank") | F.col("place")
    rows = rows.withColumns({"may": ~F.col("anchor") & ~stops & ~free & ~F.col("wrapped"), "stops": ~F.col("anchor") & stops, "broken": ~F.col("anchor") & ~free & (stops | F.col("wrapped"))})
    y_kept = F.last(F.when(F.col("may"), F.col("y")), ignorenulls=True).over(lower)
    rows = rows.withColumn("halt", F.col("stops") | sure(F.col("may") & spaced & (y_kept - F.col("y") > gap)))
    claimed = F.coalesce(F.sum((~F.col("anchor") & ~free & ~F.col("broken")).cast("int")).over(lower), F.lit(0))
    rows = rows.withColumns({"mine": F.col("may") & ~F.max("halt").over(upto) & F.col("nxt").isNotNull(), "claimed": claimed})
    rows = rows.withColumn("ends", F.col("broken") | sure(~free & (F.col("claimed") > 0) & spaced & (F.col("y_below") - F.col("y") > gap)))
    rows = rows.withColumns({"mine": F.col("mine") & (F.sum(F.col("mine").cast("int")).over(upto) <= want.lookback), "next_head": F.col("nxt").isNotNull() & ~F.max("ends").over(upto) & (F.col("claimed") < want.lookback)})

    # downwards from an anchor: head lines until the body begins, then the body's units
    block = Window.partitionBy(*keys, "entry")
    down = block.orderBy("i")
    before, until = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.unboundedPreceding, 0)
    begins = stops | sure(spaced & (F.col("y") - F.col("y_above") > gap) & F.col("text").rlike("[a-z]"))
    if want.anchor == "first_line":
        begins = begins | F.col("paragraph")
    rows = rows.withColumn("inside", ~F.col("anchor") & (F.col("entry") >= 0) & ~F.col("next_head"))
    rows = rows.withColumn("in_body", F.col("inside") & F.max(F.col("inside") & begins).over(until))
    rows = rows.withColumn("under", F.col("inside") & ~F.col("in_body") & ~F.col("wrapped") & ~F.col("blank"))
    last = F.last(F.when(F.col("under"), F.struct("y", "text")), ignorenulls=True).over(before)
    follows = near(last["y"]) & ~sure(F.trim(last["text"]).rlike("[.!?]$"))
    leaves = F.col("margin").isNotNull() & ~F.col("bullet") & ~F.col("set_in")
    rows = rows.withColumns({"head_starts": F.col("under") & ~follows, "first": F.min(F.when(F.col("in_body"), F.col("i"))).over(block), "left": F.max(F.col("in_body") & ~F.col("blank") & leaves).over(until), "bare": without_bullet(F.col("text"))})
    rows = rows.withColumn("unit_line", F.lit(want.body) & F.col("in_body") & ~F.col("blank") & ~F.col("left") & (F.col("bare") != ""))
    fresh = F.col("margin").isNotNull() & F.col("bare").rlike("^[A-Z0-9]") & ~sure(without_bullet(F.col("above")).rlike(V.DANGLING_END))
    runs_on = F.col("wrapped") | (near(F.col("y_above")) & (F.col("i") > F.col("first")) & ~F.col("bullet") & ~fresh)
    rows = rows.withColumn("unit_starts", F.col("unit_line") & (~sure(F.max("unit_line").over(before)) | ~runs_on))
    rows = rows.withColumns({f"{c}_to": F.sum(F.col(c).cast("int")).over(until) for c in ("head_starts", "unit_starts")})
    piece = lambda c, entry, kind, unit, text: F.when(c, F.struct(entry.alias("entry"), F.lit(kind).alias("kind"), unit.cast("long").alias("unit"), text.alias("part")))
    pieces = F.array(
        piece(F.col("mine"), F.col("entry") + 1, "above", F.col("i"), F.trim("text")), piece(F.col("under"), F.col("entry"), "under", F.col("head_starts_to"), F.trim("text")),
        piece(F.col("unit_line"), F.col("entry"), "body", F.col("unit_starts_to"), F.col("bare")), piece(F.col("anchor"), F.col("entry"), "anchor", F.col("i"), F.col("text")),
    )
    found = rows.select(*keys, "i", "ord", "dated", F.explode(F.array_compact(pieces)).alias("p")).select(*keys, "i", "ord", "dated", "p.*")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("i", "part"))), lambda s: s["part"])
    units = found.groupBy(*keys, "entry", "kind", "unit").agg(F.array_join(parts, " ").alias("part"), F.max("ord").alias("ord"), F.max("dated").alias("dated"))
    prose = (F.col("kind") == "under") & H.is_scope_prose(F.col("part"))
    units = units.withColumn("kind", F.when(prose, "prose").when(F.col("kind") == "under", "below").otherwise(F.col("kind")))
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("unit", "part")))), lambda s: s["part"])
    anchor = F.max(F.when(F.col("kind") == "anchor", F.struct("ord", F.col("part").alias("text"), "dated"))).alias("a")
    whole = units.groupBy(*keys, "entry").agg(anchor, *[of(k).alias(k) for k in ("above", "below", "prose", "body")]).select("*", "a.*")

    read = F.lit(True) if not want.dated_only else F.col("dated")
    text = F.col("text")
    tail = F.when(read, scope_tail(text)) if want.anchor == "date_range" else F.lit(None).cast("string")
    head = F.when(tail.isNotNull(), F.substring(text, F.lit(1), F.length(text) - F.length(tail))).otherwise(text)
    own = T.some(F.regexp_replace(F.when(read, T.without_dates(head)).otherwise(text), "^[\\s·•‣|—–-]+", ""))
    none = F.array().cast("array<string>")
    whole = whole.withColumns({"own": own, "tail": T.some(tail), "span": F.when(read, T.date_range(head)), "separator": F.when(read, T.date_separator(text))})
    mine = F.when(F.col("own").isNotNull(), F.array("own")).otherwise(none)
    scope = F.concat(F.when(F.col("tail").isNotNull(), F.array("tail")).otherwise(none), "prose")
    out = whole.select(
        *keys, "entry", "ord", F.concat("above", mine, "below").alias("header_lines"), F.when(F.col("own").isNotNull(), F.size("above")).otherwise(-1).alias("anchor_index"),
        F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.coalesce("span.current", F.lit(False)).alias("current"), "separator", T.some(F.array_join("body", "\n")).alias("body"), F.size("body").alias("bullets"), scope.alias("scope"), "below",
    )
    out = out if listed is None else out.unionByName(bullet_entries(listed, keys, want))
    return out.withColumnsRenamed(dict(zip(keys, given, strict=True)))


def _null_safe(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """A left join on keys that may be null."""
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on])
    return a.alias("a").join(b.alias("b"), same, "left").select("a.*", *[F.col(f"b.{c}") for c in b.columns if c not in on])


def scope_tail(text: Column) -> Column:
    """What stands behind a line's range, if words stand before it and it is running text; else null."""
    at = F.length(T.before(text, V.DATE_RANGE))
    range_ = F.regexp_extract(text, V.DATE_RANGE, 0)
    behind = F.regexp_replace(F.substring(text, at + F.length(range_) + 1, F.length(text)), "^[\\s)\\]}·•‣|,:;—–-]*", "")
    tail = F.rtrim(behind)
    return F.when((F.trim(T.before(text, V.DATE_RANGE)) != "") & (tail != "") & H.is_scope_prose(tail), tail)


def bullet_entries(rows: DataFrame, keys: list[str], want: Entries) -> DataFrame:
    """Entries of a section that is a list: a bullet of the outer level and the lines below it are the head, deeper bullets the body."""
    order = Window.partitionBy(*keys).orderBy("i")
    rows = rows.withColumn("anchor", F.col("bullet") & (F.col("x") <= F.col("marker") + V.MARGIN))
    rows = rows.withColumn("entry", F.sum(F.col("anchor").cast("int")).over(order) - 1).where("entry >= 0")
    down = Window.partitionBy(*keys, "entry").orderBy("i")
    deeper = F.col("bullet") & ~F.col("anchor")
    rows = rows.withColumn("unit", F.sum(deeper.cast("int")).over(down)).withColumn("part", F.when(F.col("bullet"), without_bullet(F.col("text"))).otherwise(F.trim("text")))
    units = texts_of(rows, [*keys, "entry", "unit"])
    pick = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("unit", "part")))), lambda s: s["part"])
    found = units.groupBy(*keys, "entry").agg(F.first(F.when(F.col("unit") == 0, T.spaced(F.col("part"))), ignorenulls=True).alias("whole"), pick(F.col("unit") > 0).alias("body"))
    first = rows.where("anchor").select(*keys, "entry", "ord")
    found = _null_safe(first, found, [*keys, "entry"])
    title, span, none = T.some(T.without_dates(F.col("whole"))), T.date_range(F.col("whole")), F.array().cast("array<string>")
    body = F.col("body") if want.body else none
    return found.select(
        *keys, "entry", "ord", F.when(title.isNotNull(), F.array(title)).otherwise(none).alias("header_lines"), F.lit(None).cast("int").alias("anchor_index"), span["start"].alias("start"), span["end"].alias("end"), span["current"].alias("current"),
        T.date_separator(F.col("whole")).alias("separator"), T.some(F.array_join(body, "\n")).alias("body"), F.size(body).alias("bullets"), none.alias("scope"), none.alias("below"),
    )


def unit_text(i: str, text: str) -> Column:
    """The text of a unit's lines, in order: one as it is, several trimmed and joined by blanks."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(i, text))), lambda s: s[text])
    joined = lambda p: F.trim(F.array_join(F.transform(p, lambda x, k: F.when(k == 0, F.rtrim(x)).otherwise(F.trim(x))), " "))
    return T.let(parts, lambda p: F.when(F.size(p) > 1, joined(p)).otherwise(F.get(p, 0)))


def without_wraps(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (ord, text, x, y) whose wrapped tails (set in right of the bullets) are put to the line they belong to; others stay."""
    given, keys = keys, [f"__k{i}" for i in range(len(keys))]
    rows = margins(lines.select(*[F.col(g).alias(k) for g, k in zip(given, keys, strict=True)], "ord", F.coalesce("text", F.lit("")).alias("text"), "x", "y"), keys)
    order = Window.partitionBy(*keys).orderBy("ord")
    rows = rows.withColumns({"unit": F.sum((~F.col("wrapped")).cast("int")).over(order), "i": F.col("ord")})
    rows = rows.withColumn("unit", F.greatest("unit", F.lit(1)))
    first = F.min(F.struct("ord", "x", "y", "text"))
    out = rows.groupBy(*keys, "unit").agg(first.alias("f"), unit_text("i", "text").alias("text"))
    return out.select(*[F.col(k).alias(g) for g, k in zip(given, keys, strict=True)], F.col("f.ord").alias("ord"), "text", F.col("f.x").alias("x"), F.col("f.y").alias("y"))
