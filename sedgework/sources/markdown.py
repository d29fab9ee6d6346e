"""Markdown as lines: headings, bold labels, bullets, table rows and text, with sizes that stand for their rank, and their sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions import labels as L
from sedgework.functions import values as V
from sedgework.operators.entries import sure
from sedgework.operators.sections import alias_pairs, lookup, section_of
from sedgework.sources.feeds import resolved_links

HEADING = "^\\s*(#{1,6})\\s+(.+?)\\s*#*\\s*$"
BOLD = "^\\s*[*]{2}\\s*(.+?)\\s*[*]{2}\\s*$"
CAPITALS = "^\\s*([A-Z][A-Z0-9 &/\\-]{3,60})\\s*$"
ROW, RULE, BULLET = "^\\s*\\|.*\\|\\s*$", "^\\s*\\|?\\s*:?-{2,}\\s*(?:\\|\\s*:?-{2,}\\s*)+\\|?\\s*$", "^\\s*([-*+])\\s+"


def without_emphasis(text: Column) -> Column:
    out = F.regexp_replace(text, "[*]{2}(.+?)[*]{2}", "$1")
    out = F.regexp_replace(out, "(^|[^\\w\\\\])_([^\\s_][^_]*?[^\\s_]|[^\\s_])_(?=[^\\w]|$)", "$1$2")
    return F.regexp_replace(out, "(^|[^\\w\\\\*])[*]([^\\s*][^*]*?[^\\s*]|[^\\s*])[*](?=[^\\w*]|$)", "$1$2")


def flat_links(md: Column) -> Column:
    """Markdown without images, with links as text and address, and without escapes."""
    out = F.regexp_replace(md, "!\\[[^\\]\\n]*\\]\\([^)\\n]*\\)", "")
    out = F.regexp_replace(out, "\\[([^\\]\\n]*)\\]\\(\\s*([^)\\s]+)(?:\\s+\"[^\"]*\")?\\s*\\)", "$1 $2")
    out = F.regexp_replace(out, "<((?:https?://|mailto:)[^<>\\s]+|[^<>\\s@]+@[^<>\\s]+)>", "$1")
    return F.regexp_replace(resolved_links(out), "\\\\([_*\\[\\]()!`#>.+-])", "$1")


def joined_heading(line: Column) -> Column:
    """A heading's line with its split letter put together, if that names a section."""
    payload = F.trim(F.coalesce(*[F.when(line.rlike(p), F.regexp_extract(line, p, k)) for p, k in ((HEADING, 2), (BOLD, 1), (CAPITALS, 1))]))
    joined = L.joined_letter(payload)
    return F.when(sure((joined != payload) & lookup(alias_pairs(True), F.lower(joined)).isNotNull()), F.replace(line, payload, joined)).otherwise(line)


def markdown_lines(df: DataFrame, key: str, md: str) -> DataFrame:
    """(key, ord, text, font, kind) of the lines of each text: kind is heading, label, row, bullet, capitals or text.

    Links are flattened first. Blank lines and the rules of tables are left out; ``ord`` counts what is left from 0. Headings and labels
    have larger sizes; a bold line beyond 60 characters is text.
    """
    rows = df.select(key, F.posexplode(F.split(flat_links(F.col(md)), "\r?\n")).alias("__n", "__raw")).where((F.trim("__raw") != "") & ~F.col("__raw").rlike(RULE))
    rows = rows.withColumn("__line", F.explode(F.array(joined_heading(F.col("__raw")))))
    raw = F.col("__line")
    level = F.length(F.regexp_extract(raw, HEADING, 1))
    bold = F.regexp_extract(raw, BOLD, 1)
    cells = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(F.trim(raw), "^\\|", ""), "\\|$", ""), "\\|"), lambda c: F.trim(without_emphasis(c))), lambda c: c != "")
    sizes = V.MARKDOWN_SIZES
    line = lambda kind, text, font: F.struct(F.lit(kind).alias("kind"), F.trim(text).alias("text"), font.cast("double").alias("font"))
    body = F.lit(sizes["body"])
    found = (
        F.when(raw.rlike(HEADING), line("heading", without_emphasis(F.regexp_extract(raw, HEADING, 2)), F.when(level == 1, sizes["h1"]).when(level == 2, sizes["h2"]).otherwise(sizes["h3"])))
        .when(raw.rlike(BOLD), line("label", bold, F.when(F.length(F.trim(bold)) <= 60, sizes["bold"]).otherwise(body)))
        .when(raw.rlike(ROW), line("row", F.array_join(cells, " | "), body))
        .when(raw.rlike(BULLET), line("bullet", without_emphasis(F.regexp_replace(raw, BULLET, "$1 ")), body))
        .when(raw.rlike(CAPITALS), line("capitals", raw, F.lit(sizes["bold"])))
        .otherwise(line("text", without_emphasis(raw), body))
    )
    rows = rows.withColumn("__l", F.explode(F.array(found))).where("__l.text <> '' OR __l.kind <> 'row'")
    nth = F.row_number().over(Window.partitionBy(key).orderBy("__n")) - 1
    return rows.select(key, nth.alias("ord"), F.col("__l.text").alias("text"), F.col("__l.font").alias("font"), F.col("__l.kind").alias("kind"))


def leading_section(text: Column) -> Column:
    """The section whose name a line of up to 60 characters begins with."""
    key = F.trim(F.regexp_replace(F.lower(F.trim(text)), "[:·•]+$", ""))
    found = F.regexp_extract(key, f"^({'|'.join(alias for alias, _ in alias_pairs())})(?:[ \t]|$)", 1)
    return F.when(F.length(key).between(1, V.LEADING_SECTION_CHARS), lookup(alias_pairs(), found))


def markdown_sections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Add nth, section (``profile`` before the first), heading and is_heading to lines (ord, text): by name, or by a name that begins the line.

    A soft match of the section that is open is an entry's line. What is open is the last match's section, opened or not.
    """
    order = Window.partitionBy(*keys).orderBy("ord")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    text = F.coalesce("text", F.lit(""))
    rows = lines.withColumn("__f", F.explode(F.array(section_of(text)))).withColumn("__lead", F.explode(F.array(leading_section(text))))  # each is computed once
    rows = rows.withColumns({"__soft": sure(F.col("__f.soft")), "__name": F.coalesce("__f.section", "__lead")})
    current = F.last("__name", ignorenulls=True).over(above)
    # of a soft match of the open section the leading name may still open
    again = F.col("__soft") & sure(current == F.col("__name"))
    rows = rows.withColumn("__name2", F.when(again, F.col("__lead")).otherwise(F.col("__name")))
    rows = rows.withColumn("is_heading", F.col("__name2").isNotNull())
    last = F.last(F.when(F.col("is_heading"), F.struct(F.col("__name2").alias("name"), F.trim("text").alias("heading"))), ignorenulls=True).over(order)
    rows = rows.withColumns({"nth": F.sum(F.col("is_heading").cast("int")).over(order), "section": F.coalesce(last["name"], F.lit("profile")), "heading": last["heading"]})
    return rows.drop("__f", "__lead", "__soft", "__name", "__name2")
