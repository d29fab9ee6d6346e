"""Dates in lines of text: ranges, lone dates, their display and what is left without them.

Month names are English. A date stays text, as it is written: nothing is guessed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgework.functions import values as V


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a costly expression that it uses several times, computed once: the only element of an array."""
    return F.get(F.transform(F.array(x), f), 0)


def some(x: Column) -> Column:
    """The trimmed text, null if blank."""
    return F.when(F.trim(x) != "", F.trim(x))


def spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def first_of(text: Column, pattern: str) -> Column:
    """The first match of a pattern, null if none."""
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", found)


def before(text: Column, pattern: str) -> Column:
    """The text before the first match of a pattern, null if there is no match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, f"(?is)^(.*?)(?:{pattern.removeprefix('(?i)')})", 1))


def has_date_range(text: Column) -> Column:
    return text.rlike(V.DATE_HINT) & text.rlike(V.DATE_RANGE)


def lone_date(text: Column) -> Column:
    """The first month and year, or the first bare year where that comes first."""
    month, year = f"(?i){V.STRICT_MONTH_YEAR}", V.BARE_YEAR
    at_month, at_year = F.length(before(text, month)), F.length(before(text, year))
    return F.when(at_month.isNotNull() & (at_year.isNull() | (at_month <= at_year)), spaced(first_of(text, month))).otherwise(first_of(text, year))


def date_range(text: Column) -> Column:
    """Struct of start, end and current: the first range of a line, else its first date as start; placeholders are no dates."""
    group = lambda k: F.regexp_extract(text, V.DATE_RANGE, k)
    either = lambda a, b: spaced(F.when(group(a) != "", group(a)).otherwise(group(b)))
    holder = lambda x: x.rlike(V.PLACEHOLDER_DATE)
    of = lambda s, e, c: F.struct(s.alias("start"), e.alias("end"), F.lit(c).alias("current"))
    none = F.lit(None).cast("string")
    ends = F.struct(either(1, 3).alias("start"), either(2, 4).alias("end"))
    open_ = lambda x: x.rlike(f"(?i)^({V.OPEN_END})$")
    ranged = lambda r: (
        F.when(holder(r["start"]), of(none, none, False)).when(open_(r["end"]), of(r["start"], none, True)).otherwise(of(r["start"], F.when(~holder(r["end"]), r["end"]), False))
    )
    return F.when(~has_date_range(text), of(lone_date(text), none, False)).when(group(5) != "", of(spaced(group(5)), spaced(group(6)), False)).otherwise(let(ends, ranged))


def without_dates(text: Column) -> Column:
    """A line without its first range, lone dates, open ends, brackets that held them, and separators at its ends."""
    grouped = f"(?is)^(.*?)(?:{V.DATE_RANGE.removeprefix('(?i)')})(.*)$"
    out = F.trim(F.when(text.rlike(V.DATE_HINT), F.regexp_replace(text, grouped, "$1$8")).otherwise(text))
    for pattern in (f"(?i)\\b(?:{V.OPEN_END})\\b", f"(?i){V.STRICT_MONTH_YEAR}", V.BARE_YEAR, "\\[\\s*\\]|[(]\\s*[)]"):
        out = F.trim(F.regexp_replace(out, pattern, ""))
    return F.regexp_replace(out, f"^[\\s{V.TRIMMED_SEPARATORS}]+|[\\s{V.TRIMMED_SEPARATORS}]+$", "")


def date_separator(text: Column) -> Column:
    """The mark between a line's text and its date; null where white space alone is."""
    lead = before(text, f"(?i){V.LOOSE_MONTH_YEAR}|{V.NUMERIC_MONTH_YEAR}|{V.BARE_YEAR}")
    found = F.regexp_extract(lead, f"([{V.REPORTED_SEPARATOR}])\\s*$", 1)
    return F.when(found != "", found)


def is_lone_range(text: Column, single: bool = False) -> Column:
    """Whether a line is nothing but a range of dates (with ``single``, or a year); seasons don't count."""
    t = F.trim(text)
    whole = F.regexp_extract(t, V.DATE_RANGE, 0) == t
    if single:
        whole = whole | t.rlike("^(?:19|20)[0-9]{2}$")
    return (t != "") & ~t.rlike(f"(?i)^{V.SEASON}\\b") & t.rlike("(?:19|20)[0-9]{2}|[A-Za-z'/]") & whole


def is_date_only(text: Column) -> Column:
    """Whether nothing is left of a line without date words and marks."""
    for pattern in V.DATE_WORDS:
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text) == ""


def precision(date: Column) -> Column:
    return F.when(date.rlike(f"(?i)\\b{V.LOOSE_MONTH}\\b") | date.rlike(V.NUMERIC_MONTH_YEAR), F.lit("month")).when(date.isNotNull(), F.lit("year"))


def year_of(date: Column) -> Column:
    return first_of(date, V.BARE_YEAR)


def education_dates(text: Column) -> Column:
    """Struct of start, end, current and year of a school line: a lone date is the end, and its richest form is taken."""
    return let(text, lambda t: let(date_range(t), lambda r: _education_dates(t, r["start"], r["end"], r["current"])))


def _education_dates(text: Column, start: Column, end: Column, current: Column) -> Column:
    month = first_of(text, f"(?i){V.LOOSE_MONTH_YEAR}")
    rich = F.coalesce(spaced(F.replace(month, F.lit("."), F.lit(""))), first_of(text, V.NUMERIC_MONTH_YEAR), year_of(text), end, start)
    ranged = start.isNotNull() & (current | end.isNotNull())
    out = lambda rich, last: F.struct(
        F.when(ranged, start).alias("start"), last.alias("end"), (ranged & current).alias("current"),
        F.when(ranged, F.coalesce(year_of(end), year_of(start))).otherwise(year_of(rich)).alias("year"),
        precision(F.when(ranged, start)).alias("start_precision"), precision(last).alias("end_precision"),
    )
    return let(rich, lambda x: let(F.when(ranged, end).otherwise(x), lambda last: out(x, last)))


def settled_dates(start: Column, end: Column, current: Column) -> Column:
    """Struct of start, end and current by the editor's rule: a lone end is the start; current needs a start and no end."""
    s, e = some(start), some(end)
    both = s.isNotNull() & e.isNotNull()
    return F.struct(F.coalesce(s, e).alias("start"), F.when(both, e).alias("end"), (s.isNotNull() & e.isNull() & F.coalesce(current, F.lit(False))).alias("current"))


def shown_range(start: Column, end: Column, current: Column, joint: str = " \u2013 ") -> Column:
    """A range as it is shown; one of its ends alone, or an empty text."""
    last = F.when(F.coalesce(current, F.lit(False)), F.lit("Present")).otherwise(some(end))
    return F.concat_ws(joint, some(start), last)


def parseable(date: Column) -> Column:
    """``Mon YYYY`` as the first day of that month; anything else as it is."""
    return F.regexp_replace(date, "^\\s*([A-Za-z]{3,9})[.]?\\s+([0-9]{4})\\s*$", "$1 1, $2")


def month_number(date: Column) -> Column:
    """Months since year 0 of ``Mon YYYY`` or ``YYYY``; null for other forms."""
    name, year = F.regexp_extract(date, "^\\s*([A-Za-z]{3,9})[.]?\\s+[0-9]{4}\\s*$", 1), F.regexp_extract(date, "([0-9]{4})\\s*$", 1)
    month = F.coalesce(*[F.when(F.lower(name) == k, F.lit(int(v))) for k, v in V.MONTHS.items()])
    return F.when(name != "", year.cast("int") * 12 + month).when(date.rlike("^\\s*[0-9]{4}\\s*$"), year.cast("int") * 12 + 1)


def time_ago(at: Column, as_of: Column) -> Column:
    """How long ago a time was: minutes, hours, days, months, then the date; empty if it is ahead or null."""
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))
    over = lambda n: F.floor(seconds / n).cast("string")
    day = F.concat(F.date_format(at, "MMM "), F.dayofmonth(at).cast("string"))
    return (
        F.when(seconds.isNull() | (seconds < 0), "")
        .when(seconds < 60, "now")
        .when(seconds < 3600, F.concat(over(60), F.lit("m ago")))
        .when(seconds < 86400, F.concat(over(3600), F.lit("h ago")))
        .when(seconds < 30 * 86400, F.concat(over(86400), F.lit("d ago")))
        .when(seconds < 360 * 86400, F.concat(over(30 * 86400), F.lit("mo ago")))
        .otherwise(F.when(F.year(at) != F.year(as_of), F.concat(day, F.lit(", "), F.year(at).cast("string"))).otherwise(day))
    )


def date_complaint(value: Column) -> Column:
    """What is wrong with a date field; null if nothing is, or it is blank."""
    bad = F.when(value.rlike(V.PLACEHOLDER_FIELD), V.PLACEHOLDER_MESSAGE).when(~value.rlike(V.DATE_FIELD), V.DATE_MESSAGE)
    return F.when(F.trim(value) != "", bad)
