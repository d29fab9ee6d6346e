"""Scalar text functions: Column to Column, all inside Spark's generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgework.functions import values as V

END = "($|[^0-9a-z_])"
START = "(^|[^0-9a-z_])"


def floor_half(x: Column) -> Column:
    """Round half up; the engines' own rounding differs for negative numbers."""
    return F.floor(x + F.lit(0.5))


def tokens(text: Column) -> Column:
    """White-space separated, non-empty tokens."""
    return F.filter(F.split(text, "\\s+"), lambda t: t != "")


def count_words(text: Column) -> Column:
    """Tokens that contain a letter or a digit."""
    return F.size(F.filter(F.split(text, "\\s+"), lambda t: t.rlike("[\\p{L}\\p{N}]")))


def bullet_text(line: Column) -> Column:
    """A line without its bullet marker or number."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, V.BULLET_MARKER, ""), V.NUMBERED_BULLET, ""))


def has_metric(text: Column) -> Column:
    """Whether a line quantifies: a strong pattern, a digit outside years, or a counting word before a noun.

    Most lines have neither digit nor counting word: two cheap tests come first.
    """
    gap = V.CARDINAL_GAP
    strong = reduce(lambda a, b: a | b, (text.rlike(p) for p in V.STRONG_METRICS))
    # two passes: neighbouring years share the character between them
    no_year = F.regexp_replace(F.regexp_replace(text, V.YEAR, "$1$3"), V.YEAR, "$1$3")

    def counting(low: Column) -> Column:
        no_word_year = F.regexp_replace(low, f"{START}(two{gap}+thousand|nineteen{gap}+hundred)({gap}+and)?{gap}+({V.YEAR_TAIL}){END}", " ")
        return F.regexp_replace(no_word_year, V.NOT_COUNTING, " ").rlike(f"{START}({V.CARDINALS}){gap}[0-9a-z_]")

    some_word = F.lower(text).rlike(f"{START}({V.CARDINALS}){gap}")
    return F.when(text.rlike("[0-9]"), strong | no_year.rlike("[0-9]") | counting(F.lower(no_year))).when(some_word, counting(F.lower(text))).otherwise(False)


def starts_with_verb(text: Column) -> Column:
    """Whether the letters of the first token are an action verb."""
    first = F.regexp_replace(F.lower(F.element_at(F.split(text, "\\s"), 1)), "[^a-z]", "")
    return first.isin(*V.ACTION_VERBS)


def leading_verb(line: Column) -> Column:
    """The first alphabetic token after list marks, emphasis and quotes; null if none."""
    bare = F.trim(line)
    for pattern in ("^[0-9]+[.)]\\s*", "^[•*-]\\s*", "^[*]+", "^[\"'`“‘]"):
        bare = F.regexp_replace(bare, pattern, "")
    found = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z'-]+)", 1))
    return F.when(found != "", found)


def bullet_key(text: Column) -> Column:
    """Identity of a line: no marker, single spaces, lower case."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, V.BULLET_MARKER, "")), "\\s+", " "))


def flat(text: Column) -> Column:
    """Lower case, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "))


def flat_company(name: Column) -> Column:
    """``flat`` without legal forms at its end, as long as a word is left."""
    return F.regexp_replace(flat(name), f"( ({'|'.join(V.LEGAL_SUFFIXES)}))+$", "")


def token_set(text: Column, least: int = 1) -> Column:
    return F.array_distinct(F.filter(F.split(flat(text), " "), lambda t: F.length(t) >= least))


def containment(a: Column, b: Column) -> Column:
    """Shared members over the smaller set; 0 if one is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def title_tokens(text: Column) -> Column:
    """Search tokens of a title: letters, digits, ``+ # .``, dots trimmed off the ends."""
    parts = F.transform(F.split(F.lower(text), "[^a-z0-9+#.]+"), lambda t: F.regexp_replace(t, "^[.]+|[.]+$", ""))
    return F.filter(parts, lambda t: t != "")


def significant_skill(term: Column) -> Column:
    return ~term.isin(*V.QUERY_STOPWORDS) & ((F.length(term) >= 3) | term.rlike("[^a-z0-9]"))


def admitting_term(term: Column) -> Column:
    return ~term.isin(*V.QUERY_STOPWORDS) & (F.length(term) >= 3)


def seniority(title: Column) -> Column:
    """The label of the first pattern that a title matches; null if none does."""
    low = F.lower(title)
    found = [F.when(low.rlike(f"{START}({p}){END}"), F.lit(label)) for label, p in V.SENIORITY_PATTERNS]
    return F.coalesce(*found)


def rung(label: Column) -> Column:
    return F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in V.SENIORITY_RUNGS.items()])


def is_remote(place: Column) -> Column:
    return F.lower(place).rlike(f"{START}({'|'.join(V.REMOTE_WORDS)}){END}")


def place_matches(wanted: Column, place: Column) -> Column:
    """Remote, or the same city (text before a comma), or one contains the other; empty never matches."""
    w, p = F.lower(F.trim(wanted)), F.lower(F.trim(place))
    city = lambda x: F.trim(F.substring_index(x, ",", 1))
    return is_remote(place) | ((w != "") & (p != "") & ((city(w) == city(p)) | p.contains(w) | w.contains(p)))


def for_matching(text: Column) -> Column:
    """Plain forms of dashes, quotes, ellipses and odd spaces; no NULs, zero-width or replacement characters."""
    out = F.regexp_replace(text, "[\\x00\ufffd]", "")
    for pattern, plain in (("[\u2013\u2014]", "-"), ("[\u201c-\u201f]", '"'), ("[\u2018-\u201b]", "'"), ("\u2026", "..."), ("[\u200b-\u200d\u2060\ufeff]", ""), ("\u00a0", " ")):
        out = F.regexp_replace(out, pattern, plain)
    return out


def html_text(html: Column) -> Column:
    """Plain text by patterns: scripts and styles go, block ends are line ends, common references are decoded."""
    out = F.regexp_replace(html, "(?is)<(style|script)([^0-9a-z_][^>]*)?>.*?</(style|script)>", "")
    out = F.regexp_replace(out, "(?i)</(p|li|div|tr)>", "\n")
    out = F.regexp_replace(out, "(?i)<br\\s*/?>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", "")
    for name, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(name), F.lit(plain))
    out = F.regexp_replace(out, "[ \\t\\r\\f]+\n", "\n")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.regexp_replace(out, "^\\s+|\\s+$", "")


def posting_signal(text: Column) -> Column:
    """Summed weight of the signals in a page's text and URL."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, (F.when(low.rlike(p), F.lit(w)).otherwise(F.lit(0)) for p, w in V.POSTING_SIGNALS))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({V.EMAIL})"), 1)


def first_phone(text: Column) -> Column:
    found = F.regexp_extract(text, V.PHONE, 0)
    return F.when(found != "", found)


def iso_month(raw: Column) -> Column:
    """``Mon YYYY``, ``M/YYYY`` and ``YYYY/M`` as ``YYYY-MM``; ISO dates and anything else stay."""
    s = F.trim(raw)
    name, year = F.regexp_extract(s, "^([A-Za-z]{3,9})[.]?\\s+[0-9]{4}$", 1), F.regexp_extract(s, "([0-9]{4})$", 1)
    month = F.coalesce(*[F.when(F.lower(name) == k, F.lit(v)) for k, v in V.MONTHS.items()])
    back, fore = F.regexp_extract(s, "^([0-9]{1,2})/[0-9]{4}$", 1), F.regexp_extract(s, "^[0-9]{4}/([0-9]{1,2})$", 1)
    ok = lambda m: (m != "") & m.cast("int").between(1, 12)
    return (
        F.when((name != "") & month.isNotNull(), F.concat_ws("-", year, month))
        .when(ok(back), F.concat_ws("-", year, F.lpad(back, 2, "0")))
        .when(ok(fore), F.concat_ws("-", F.substring(s, 1, 4), F.lpad(fore, 2, "0")))
        .otherwise(F.when(s != "", s))
    )


def tier(score: Column) -> Column:
    out = F.when(score >= V.TIERS[0][0], V.TIERS[0][1])
    return out.when(score >= V.TIERS[1][0], V.TIERS[1][1]).otherwise(V.TIERS[2][1])


def size_bucket(kilobytes: Column) -> Column:
    return F.coalesce(*[F.when(kilobytes < limit, F.lit(name)) for limit, name in V.SIZE_BUCKETS], F.lit("1000kb+"))


def garbled(text: Column) -> Column:
    """At least 40 characters of which more than three tokens in ten are single characters."""
    parts = F.split(text, "\\s+")
    return (F.length(text) >= 40) & (F.size(F.filter(parts, lambda t: F.length(t) == 1)) / F.size(parts) > 0.3)
