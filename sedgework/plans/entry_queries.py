"""Queries over lines with places: sections of documents, and the entries of their sections.

The tables hold no résumé lines, so sentences of all documents are given marks, dates and places by expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.operators import entries as E
from sedgework.operators import header_fields as A
from sedgework.operators import names as N
from sedgework.operators import sections as S
from sedgework.plans.registry import Registry
from sedgework.sources.tables import dealt_out, table

R = Registry()

HEADINGS = ("EXPERIENCE", "Relevant Experience", "PROJECTS", "Awards & Honors", "Teaching Experience", "SKILLS", "Side Quests", "EDUCATION")


def placed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, ord, text, font, gap, band, x, y): the sentences of all documents as lines of a page."""
    # texts are dealt by document before they are parted, so lines need no shuffle
    docs = dealt_out(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    s = docs.select("doc_id", F.posexplode(F.split("text", "\n|(?<=[.]) ")).alias("ord", "s"))
    c = lambda n: F.initcap(F.substring("s", 1, n))
    turn, year = (F.col("doc_id") + F.col("ord")) % 12, (F.col("doc_id") * 7 + F.col("ord")) % 25 + 1990
    heading = F.element_at(F.array(*map(F.lit, HEADINGS)), ((F.col("doc_id") + F.floor(F.col("ord") / 12)) % len(HEADINGS) + 1).cast("int"))
    marked = F.concat(F.lit("• "), "s")
    text = (
        F.when(turn == 0, heading).when(turn == 1, c(24)).when(turn == 2, F.concat(c(16), F.lit("  Jan "), year, F.lit(" - Mar "), year + 2)).when(turn.isin(3, 4, 5, 8, 10), marked)
        .when(turn == 6, F.lower("s")).when(turn == 7, F.concat(c(20), F.lit(" · Acme  "), year)).when(turn == 9, F.concat(F.lit("Early "), c(20))).otherwise("")
    )
    rows = s.select("doc_id", "ord", text.alias("text"), F.when(turn == 0, 13.0).otherwise(10.0).alias("font"), F.when(turn.isin(0, 1), 28.0).otherwise(14.0).alias("gap"), F.lit(None).cast("string").alias("band"), turn.alias("turn"))
    x = F.when(F.col("turn") == 6, 90.0).when(F.col("text").startswith("•"), 64.0).otherwise(50.0)
    return rows.select("doc_id", "ord", "text", "font", "gap", "band", x.alias("x"), (F.col("ord") * 14.0 + F.floor((F.col("doc_id") + F.col("ord")) / 12) * 14.0).alias("y"))


def flat(blocks: DataFrame, *keys: str) -> DataFrame:
    lists = [F.array_join(c, " | ").alias(c) for c in ("header_lines", "scope", "below")]
    return blocks.select(*keys, "entry", "ord", "anchor_index", "start", "end", "current", "separator", F.length("body").alias("body_chars"), "bullets", *lists)


@R.query()
def entry_blocks(spark, sf):
    """Every document's lines as one section of dated entries."""
    return flat(E.entry_blocks(placed_lines(spark, sf), ["doc_id"]), "doc_id")


@R.query()
def named_sections(spark, sf):
    """The section of every line, with experience that has no heading."""
    lines = S.recovered_experience(S.sections(placed_lines(spark, sf), ["doc_id"]), ["doc_id"])
    return lines.select("doc_id", "ord", "nth", "section", "heading", "is_heading")


@R.query()
def section_contents(spark, sf):
    """Each section's heading, lines and characters, sections of one name together."""
    found = S.by_name(S.sections(placed_lines(spark, sf), ["doc_id"]), ["doc_id"])
    return found.select("doc_id", "section", "heading", F.size("lines").alias("lines"), F.length(F.array_join("lines", "\n")).alias("chars"))


@R.query()
def project_entries(spark, sf):
    """Entries that a name opens, of the sections of projects and achievements."""
    lines = S.sections(placed_lines(spark, sf), ["doc_id"]).where("NOT is_heading AND section IN ('projects', 'achievements')")
    return flat(E.entry_blocks(lines, ["doc_id", "nth"], E.Entries("first_line", 0)), "doc_id", "nth")


@R.query()
def entry_fields(spark, sf):
    """Title, employer, place and team of every dated entry, by each document's own order."""
    # fields are read off heads: bodies are not put together
    found = E.entry_blocks(placed_lines(spark, sf), ["doc_id"], E.Entries(body=False)).select("doc_id", "entry", "header_lines", "anchor_index")
    return A.header_fields(found, ["doc_id"]).drop("header_lines")


@R.query()
def names_and_headlines(spark, sf):
    """The likeliest name and headline among the lines above each document's first heading."""
    lines = S.sections(placed_lines(spark, sf), ["doc_id"]).where("section = 'profile'")
    return N.names_and_headlines(lines, ["doc_id"])
