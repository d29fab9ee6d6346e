"""Sections of a document, opened by headings that are known by name or seen by style.

A heading's name comes from a dictionary, tier by tier: the whole heading, an experience heading without its
qualifiers, letters put together, one side of a pair, or the last word of a short title-cased line (a soft match).
A line that only looks like a heading opens ``other``. Which lines open a section depends on the ones before, but
only through the last heading and through the line above, so running aggregates decide it.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions import dates as T
from sedgework.functions import labels as L
from sedgework.functions import shapes as H
from sedgework.functions import text as X
from sedgework.functions import values as V
from sedgework.operators.entries import is_bullet, margins, sure, unit_text


def lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(pairs))), key)


def alias_pairs(split_letters: bool = False) -> list[tuple[str, str]]:
    return [(a, name) for name, (aliases, _, split, _) in V.SECTION_NAMES.items() if split or not split_letters for a in aliases]


def heading_key(text: Column) -> Column:
    """A heading's lower-case text without marks at its end, and without signs before its first letter unless it is a bullet."""
    low = F.trim(F.regexp_replace(F.lower(F.trim(text)), "[:·•]+$", ""))
    return F.when(text.rlike(V.LINE_BULLET), low).otherwise(F.regexp_replace(low, "^[^\\p{L}\\p{N}]+(?=\\p{L})", ""))


def last_word_section(key: Column) -> Column:
    """The section that a heading's last word names."""
    pairs = [(a, name) for name, (_, anchors, _, enough) in V.SECTION_NAMES.items() if enough for a in anchors]
    return lookup(pairs, F.try_element_at(X.tokens(key), F.lit(-1)))


def soft_section(text: Column, key: Column) -> Column:
    """By the last word of up to four title-cased words that are no sentence and no organisation's name."""
    initials = lambda w: w.rlike("^[A-Z]{2,}$")

    def titled(words: Column) -> Column:
        first = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
        named = ~F.forall(words, lambda w: w == F.upper(w)) & F.exists(words, initials) & F.exists(first, lambda w: ~initials(w) & w.rlike("^[A-Z]"))
        school = F.exists(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w.rlike(V.NAMED_SCHOOL))
        return F.forall(words, lambda w: w.rlike("^[A-Z]")) & ~named & ~school

    fits = ~key.rlike("[.!?]$") & F.size(X.tokens(key)).between(1, V.SECTION_WORDS) & T.let(X.tokens(F.trim(text)), titled)
    return F.when(fits, last_word_section(key))


def section_of(text: Column) -> Column:
    """Struct of section and soft for a heading that is known by name; nulls for others."""
    return T.let(text, lambda t: T.let(heading_key(t), lambda key: _section_of(t, key)))


def _section_of(text: Column, key: Column) -> Column:
    free = ~text.rlike(V.LINE_BULLET)

    def is_qualified(words: Column) -> Column:
        before = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
        return (F.size(words) >= 2) & (F.try_element_at(words, F.lit(-1)) == "experience") & F.forall(before, lambda w: w.isin(*V.EXPERIENCE_QUALIFIERS))

    known = lambda k: lookup(alias_pairs(), k)
    side = lambda k: F.when((key.contains("&") | key.contains("and")) & free, known(F.trim(T.some(F.regexp_extract(key, "^(.+?)\\s+(?:&|and)\\s+(.+)$", k)))))
    fits = F.length(key).between(1, V.SECTION_CHARS)
    # an alias comes first in the order of the sections, so a qualified heading counts as experience at its place there
    exact = F.coalesce(known(key), F.when(T.let(X.tokens(key), is_qualified), F.lit("experience")))
    hard = F.when(fits, F.coalesce(exact, lookup(alias_pairs(True), L.joined_letter(key)), side(1), side(2)))
    soft = lambda h: F.when(h.isNull() & fits & free, soft_section(text, key))
    both = lambda h, s: F.struct(F.coalesce(h, s).alias("section"), (h.isNull() & s.isNotNull()).alias("soft"))
    return T.let(hard, lambda h: T.let(soft(h), lambda s: both(h, s)))


def is_lone_capital(text: Column) -> Column:
    """One word of capitals alone."""
    t = F.trim(text)
    capitals = T.let(F.regexp_replace(t, "[^A-Za-z]", ""), lambda x: (x != "") & (x == F.upper(x)))
    return F.length(t).between(1, V.HEADER_CHARS) & ~t.rlike(V.LINE_BULLET) & ~t.rlike("[.!?]$") & ~t.rlike(V.HEADER_DIRT) & capitals & (H.word_count(t) == 1)


def usual(rows: DataFrame, keys: list[str], value: Column, counts: Column, name: str, default: float) -> DataFrame:
    """Add the value that most characters have (of equal ones the first met), or a default."""
    rows = rows.withColumn("__v", F.when(counts, value)).withColumn("__n", F.when(F.col("__v").isNotNull(), F.length(F.trim("text"))))
    at = Window.partitionBy(*keys, "__v")
    rows = rows.withColumns({"__c": F.sum("__n").over(at), "__f": F.min("ord").over(at)})
    best = F.max(F.when(F.col("__c") > 0, F.struct("__c", (-F.col("__f")).alias("f"), "__v"))).over(Window.partitionBy(*keys))
    return rows.withColumn(name, F.coalesce(best["__v"], F.lit(default))).drop("__v", "__n", "__c", "__f")


def sections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Add to ``lines`` (ord, text, font, gap, band) the section that each belongs to.

    ``gap`` is the space above a line; ``band`` is ``sidebar`` for lines in the narrow column of a two-column page, ``body`` or
    ``unknown`` for others of such a page and null elsewhere. Adds nth (number of the section, 0 for what stands before the
    first heading), section (``profile`` there), heading (its line's text) and is_heading. A null text is a blank line.
    """
    given, keys = keys, [f"__k{i}" for i in range(len(keys))]
    others = [c for c in lines.columns if c not in (*given, "ord", "text", "font", "gap", "band", "nth", "section", "heading", "is_heading")]
    rows = lines.select(*[F.col(g).alias(k) for g, k in zip(given, keys, strict=True)], "ord", F.coalesce("text", F.lit("")).alias("text"), "font", "gap", "band", F.struct(*others, F.lit(0).alias("__")).alias("__o"))
    part = Window.partitionBy(*keys)
    order = part.orderBy("ord")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    text = F.col("text")
    t = F.trim(text)
    short = F.length(t).between(1, V.HEADER_CHARS) & ~text.rlike(V.LINE_BULLET) & ~t.rlike("[.!?]$") & (H.word_count(t) <= V.HEADER_WORDS)
    last_word = F.when(F.col("band") == "sidebar", last_word_section(F.regexp_replace(heading_key(text), "^[^\\p{L}\\p{N}]+(?=\\p{L})", "")))
    # what is read off a line alone is computed once, as one struct of it; the windows behind use its fields
    line = F.struct(
        section_of(text).alias("found"), sure(T.has_date_range(text)).alias("dated"), sure(H.has_contact(text)).alias("contact"), sure(short).alias("short"), sure(H.is_capital_header(text)).alias("capitals"),
        sure(is_lone_capital(text)).alias("lone"), last_word.alias("last_word"),
    )
    rows = rows.withColumn("__line", F.explode(F.array(line))).select("*", F.col("__line.found.section").alias("name"), F.col("__line.found.soft").alias("soft"), *[F.col(f"__line.{c}").alias(c) for c in ("dated", "contact", "short", "capitals", "lone", "last_word")]).drop("__line")
    rows = usual(rows, keys, F.round("font", 1), F.lit(True), "usual_font", V.DEFAULT_FONT)
    rows = usual(rows, keys, F.round(F.col("gap") * 2) / 2, F.col("gap") > 0, "usual_gap", V.DEFAULT_LINE_HEIGHT)
    rows = rows.withColumns({"entry": F.col("dated") | sure(F.lead("dated").over(order)), "two": F.max(F.col("band").isNotNull()).over(part)})
    # headings by style count behind the block of the name, which a line of contact data or a known heading ends
    past = sure(F.max(F.col("contact") | F.col("name").isNotNull()).over(above))
    rows = rows.withColumn("past", past)
    large = sure((F.col("short") & (F.col("font") >= F.col("usual_font") * V.HEADER_FONT)) | F.col("capitals"))
    alone = sure(F.col("lone") & (F.col("gap") >= F.col("usual_gap") * V.HEADER_GAP))
    rail = F.when((F.col("band") == "sidebar") & ~F.col("entry") & F.col("short") & ~large & ~alone, F.col("last_word"))
    rows = rows.withColumn("side", F.when(F.col("name").isNull(), rail))
    by_style = F.col("name").isNull() & F.col("past")
    # o: opens, n: doesn't, a: opens if the line above doesn't
    kind = F.when(by_style & large, "o").when(by_style & alone, "a").when(F.col("side").isNotNull() | (F.col("name").isNotNull() & ~F.col("soft")), "o").when(F.col("name").isNotNull(), "s").otherwise("n")
    rows = rows.withColumns({"kind": kind, "name": F.coalesce("name", "side", F.when(by_style & (large | alone), "other"))})
    rows = rows.withColumn("opens", alternating(F.when(F.col("kind") == "s", "o").otherwise(F.col("kind")), order))
    # a soft heading of the section that is open is an entry's line, but a bare one of experience may open the next group
    current = F.last(F.when(F.col("opens"), F.col("name")), ignorenulls=True).over(above)
    group = (F.col("name") == "experience") & ~F.col("two") & ~F.col("entry")
    rows = rows.withColumn("kind", F.when(F.col("kind") != "s", F.col("kind")).when(~sure(current == F.col("name")), "o").when(group, "a").otherwise("n"))
    rows = rows.withColumn("opens", alternating(F.col("kind"), order))
    rows = rows.withColumn("nth", F.sum(F.col("opens").cast("int")).over(order))
    heading = F.when(F.col("side").isNotNull(), F.regexp_replace(F.trim(text), "^(?:[^\\p{Lu}\\s]\\S*\\s+)+(?=\\S)", "")).otherwise(F.trim(text))
    last = F.last(F.when(F.col("opens"), F.struct("name", heading.alias("heading"))), ignorenulls=True).over(order)
    return rows.select(
        *[F.col(k).alias(g) for g, k in zip(given, keys, strict=True)], "ord", "text", "font", "gap", "band", *[F.col(f"__o.`{c}`").alias(c) for c in others],
        F.col("nth").alias("nth"), F.coalesce(last["name"], F.lit("profile")).alias("section"), last["heading"].alias("heading"), F.col("opens").alias("is_heading"),
    )


def alternating(kind: Column, order) -> Column:
    """Whether a line opens: ``o`` does, ``n`` doesn't, and in a run of ``a`` every other line does, as the line above it doesn't."""
    place = F.row_number().over(order)
    fixed = F.last(F.when(kind != "a", F.struct(place.alias("i"), (kind == "o").alias("o"))), ignorenulls=True)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return _resolve(fixed.over(upto), place)


def _resolve(last: Column, place: Column) -> Column:
    steps = place - F.coalesce(last["i"], F.lit(0))
    first = F.coalesce(last["o"], F.lit(False))
    return F.when(steps % 2 == 0, first).otherwise(~first)


def is_role_head(text: Column) -> Column:
    """A dated line that can only be a role's: a strong date behind a capital head that names no school and no degree."""
    t = F.trim(text)
    named = lambda head: head.rlike("^\\p{Lu}") & H.is_entry_header(head) & ~H.has_word(head, V.SCHOOL_WORDS) & ~head.rlike(f"^(?:{V.DEGREE.removeprefix(chr(92) + 'b')})")
    return sure(~is_bullet(text) & t.rlike(V.STRONG_DATE) & T.let(F.trim(T.before(t, V.DATE_RANGE)), named))


def recovered_experience(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of ``sections``; in one-column documents without experience the first host section's lines from its first role on become one.

    A host (profile, summary or other) needs two role heads. The new section follows its host and has no heading.
    """
    part = Window.partitionBy(*keys)
    role = F.col("section").isin(*V.HEADERLESS_HOSTS) & ~F.col("is_heading") & is_role_head(F.col("text"))
    rows = lines.withColumn("__role", role)
    rows = rows.withColumns({"__n": F.sum(F.col("__role").cast("int")).over(Window.partitionBy(*keys, "nth")), "__has": F.max((F.col("section") == "experience") | F.col("band").isNotNull()).over(part)})
    rows = rows.withColumn("__host", F.min(F.when(~F.col("__has") & (F.col("__n") >= V.HEADERLESS_ROLES), F.col("nth"))).over(part))
    rows = rows.withColumn("__from", F.min(F.when((F.col("nth") == F.col("__host")) & F.col("__role"), F.col("ord"))).over(part))
    mine = sure((F.col("nth") == F.col("__host")) & (F.col("ord") >= F.col("__from")))
    behind = mine | sure(F.col("nth") > F.col("__host"))
    out = rows.withColumns({"nth": F.col("nth") + behind.cast("int"), "section": F.when(mine, "experience").otherwise(F.col("section")), "heading": F.when(~mine, F.col("heading"))})
    return out.drop("__role", "__n", "__has", "__host", "__from")


def by_name(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section, heading, lines): each section's lines in order, wrapped bullets put together, blanks left out.

    ``lines`` are those of ``sections`` with x and y. Sections of one name are one; the heading is that of the first.
    """
    given, keys = keys, [f"__k{i}" for i in range(len(keys))]
    rows = lines.select(*[F.col(g).alias(k) for g, k in zip(given, keys, strict=True)], "nth", "section", "heading", "is_heading", "ord", F.coalesce("text", F.lit("")).alias("text"), "x", "y")
    units = [*keys, "nth", "section"]
    # one pass: a heading is a unit of its own, as a section may have no other line
    rows = margins(rows, units, ~F.col("is_heading"))
    unit = F.when(F.col("is_heading"), 0).otherwise(F.greatest(F.sum((~F.col("wrapped") & ~F.col("is_heading")).cast("int")).over(Window.partitionBy(*units).orderBy("ord")), F.lit(1)))
    rows = rows.withColumn("unit", unit)
    named = F.min(F.when(F.col("heading").isNotNull(), F.struct("nth", "heading")))
    whole = rows.groupBy(*units, "unit").agg(F.min("ord").alias("ord"), F.trim(unit_text("ord", "text")).alias("t"), named.alias("named"))
    line = F.when((F.col("unit") > 0) & (F.col("t") != ""), F.struct("nth", "ord", "t"))
    found = whole.groupBy(*keys, "section").agg(F.min("named").alias("named"), F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]).alias("lines"))
    return found.select(*[F.col(k).alias(g) for g, k in zip(given, keys, strict=True)], "section", F.col("named.heading").alias("heading"), "lines")
