"""Small text forms: sizes, slugs, ids, keys, pay, snippets, letters set apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgework.functions import urls as U
from sedgework.functions import values as V


def shown_size(n: Column) -> Column:
    """Bytes as B, KB (one decimal) or MB (two)."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.2f", n / (1024.0 * 1024)), F.lit(" MB")))


def slug(name: Column) -> Column:
    """A name for files: ASCII word characters, blanks as hyphens, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[^0-9A-Za-z_\\s-]", ""), "^\\s+|\\s+$", ""), "\\s+", "-"))


def status_bucket(status: Column) -> Column:
    return F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in V.STATUS_ALIASES.items()], status)


def joined_letter(text: Column) -> Column:
    """``S kills`` as ``Skills``: a letter alone goes to the word of three letters or more behind it."""
    return F.regexp_replace(text, "\\b([A-Za-z])\\s+([A-Za-z]{3,})\\b", "$1$2")


def tight_letters(text: Column) -> Column:
    """Runs of four single letters or more without the blanks between them."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit("(?<!\\p{L})((?:\\p{L} ){3,}\\p{L})(?!\\p{L})"), 1))
    return F.when(text.contains(" "), F.aggregate(runs, text, lambda t, run: F.replace(t, run, F.replace(run, F.lit(" "), F.lit(""))))).otherwise(text)


def id_text(bullet_id: Column) -> Column:
    """The text of a line's id (number, bar, text); null for other forms."""
    found = F.regexp_extract(bullet_id, "(?s)^[0-9]+[|](.+)$", 1)
    return F.when(found != "", found)


def pair_key(a: Column, b: Column) -> Column:
    """One key for a pair in either order."""
    return F.concat(F.least(a, b), F.lit("\u0000"), F.greatest(a, b))


def url_id(url: Column) -> Column:
    """An id made of a canonical URL without its scheme; null if there is none."""
    return F.concat(F.lit("job:"), F.regexp_replace(U.canonical(url), "^https?://", ""))


def money(amount: Column, currency: Column) -> Column:
    sign = F.coalesce(*[F.when(currency == k, F.lit(v)) for k, v in V.CURRENCY_SIGNS.items()], F.concat(currency, F.lit(" ")))
    return F.concat(sign, F.format_number(F.floor(amount + 0.5), 0))


def shown_pay(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """A range of pay as it is shown on a card."""
    suffix = F.coalesce(*[F.when(period == k, F.lit(v)) for k, v in V.PAY_SUFFIXES.items()], F.lit("/yr"))
    ranged = low.isNotNull() & high.isNotNull() & (low != high)
    body = F.when(ranged, F.concat(money(low, currency), F.lit("–"), money(high, currency))).otherwise(money(F.coalesce(high, low, F.lit(0)), currency))
    return F.concat(body, suffix)


def snippet(text: Column, start: Column, length: Column, window: int) -> Column:
    """The text around a place (from 0), with ellipses where it is cut."""
    half = window // 2
    lo, hi = F.greatest(F.lit(0), start - half), F.least(F.length(text), start + length + half)
    cut = F.trim(F.regexp_replace(F.substring(text, lo + 1, hi - lo), "\\s+", " "))
    return F.concat(F.when(lo > 0, "…").otherwise(""), cut, F.when(hi < F.length(text), "…").otherwise(""))


def requirements_part(text: Column) -> Column:
    """The text from its first line with a heading of requirements on, in lower case; empty if there is none."""
    lines = F.split(text, "\n")
    first = F.array_position(F.transform(lines, lambda line: line.rlike(V.REQUIREMENTS_HEADING)), True)
    return F.when(first > 0, F.lower(F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), "\n"))).otherwise("")


def occurrences(text: Column, phrase: str) -> Column:
    """How often a phrase of word characters stands in a text, between word ends."""
    import re

    return F.when(F.lit(phrase) == "", 0).otherwise(F.size(F.regexp_extract_all(text, F.lit(f"(?<![0-9A-Za-z_])({re.escape(phrase)})(?![0-9A-Za-z_])"), 1)))


def fewer_blanks(text: Column) -> Column:
    """At most one empty line in a row, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def html_markdown(html: Column) -> Column:
    """HTML as markdown by patterns: headings, bold, italic, list items, breaks, references."""
    out = html
    for k in range(1, 7):
        out = F.regexp_replace(out, f"(?is)<h{k}[^>]*>\\s*(.*?)\\s*</h{k}>", f"\n\n{'#' * k} $1\n\n")
    for pattern, by in (
        ("(?is)<(?:strong|b)(?:\\s[^>]*)?>(.*?)</(?:strong|b)>", "**$1**"), ("(?is)<(?:em|i)(?:\\s[^>]*)?>(.*?)</(?:em|i)>", "*$1*"), ("(?is)<li[^>]*>\\s*(.*?)\\s*</li>", "- $1\n"),
        ("(?i)</?(?:ul|ol)[^>]*>", "\n"), ("(?i)<br\\s*/?>", "\n"), ("(?i)</p>", "\n\n"), ("(?i)</div>", "\n"), ("<[^>]+>", ""),
    ):
        out = F.regexp_replace(out, pattern, by)
    for name, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(name), F.lit(plain))
    return fewer_blanks(out)
