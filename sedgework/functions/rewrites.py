"""Lines that a model has rewritten, and lines as they are shown: marks taken off, metrics marked, labels split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgework.functions import values as V

OPEN, CLOSE = "", ""


def bold_metrics(text: Column) -> Column:
    """A text with its metrics between two private marks; what is marked already stays as it is."""
    whole = f"{OPEN}[^{OPEN}{CLOSE}]+{CLOSE}"
    marked = F.regexp_extract_all(text, F.lit(f"({whole})"), 1)
    plain = F.transform(F.split(text, whole), lambda p: F.regexp_replace(p, V.BOLD_METRIC, f"{OPEN}$1{CLOSE}"))
    return F.array_join(F.transform(plain, lambda p, i: F.concat(p, F.coalesce(F.get(marked, i), F.lit("")))), "")


def without_marks(line: Column) -> Column:
    """One layer of marks less: a bold word first, emphasis around the whole line, a list's mark."""
    out = F.regexp_replace(line, "^[*]{2}([A-Za-z][\\w-]*)[*]{2}\\s+", "$1 ")
    for pattern in ("(?s)^[*]{2}(.+)[*]{2}$", "(?s)^[*](.+)[*]$", "(?s)^_(.+)_$"):
        out = F.regexp_replace(out, pattern, "$1")
    return F.regexp_replace(out, V.LIST_MARK, "")


def clean_line(line: Column, layers: int = 32) -> Column:
    """A rewritten line without the words that announce it, marks around it and quotes; empty for an announcement alone."""
    bare = F.regexp_replace(F.trim(line), "(?i)^rewritten:\\s*", "")
    peeled = F.aggregate(F.sequence(F.lit(1), F.lit(layers)), bare, lambda s, _: F.when(s.rlike("^(?:[*_•-]|[0-9]+[.)])"), without_marks(s)).otherwise(s))
    out = F.trim(F.regexp_replace(F.regexp_replace(peeled, "^[\"'`“‘]", ""), "[\"'`”’]$", ""))
    return F.when(F.trim(line).rlike(V.CHAT_OPENER) | F.lower(out).isin(*V.PROMPT_ECHO), "").otherwise(F.coalesce(out, F.lit("")))


def split_label(title: Column) -> Column:
    """Struct of type and rest of a title with a short label before a middle dot; null if there is none."""
    at = F.instr(title, " · ")
    label = F.trim(F.substring(title, F.lit(1), at - 1))
    return F.when((at > 0) & F.length(label).between(1, V.ACHIEVEMENT_TYPE_CHARS), F.struct(label.alias("type"), F.substring(title, at + 3, F.length(title)).alias("rest")))


def kept_rewrite(original: Column, rewritten: Column, dropped: Column, added: Column) -> Column:
    """Struct of lines and reverted: the rewriting, unless it drops or invents a number."""
    revert = (F.size(rewritten) > 0) & ((F.size(dropped) > 0) | (F.size(added) > 0))
    return F.struct(F.when(revert, original).otherwise(rewritten).alias("lines"), revert.alias("reverted"))
