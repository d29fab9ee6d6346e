"""Queries over markdown: the turns of all conversations, with marks put in by an expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.plans.registry import Registry
from sedgework.sources import markdown as M
from sedgework.sources.tables import table

R = Registry()


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """(turn_id, md): each turn under a heading, its sentences as bullets, labels, rows and text, with a link."""
    c = table(spark, sf, "conversations")
    n = F.col("conv_id") * 100 + F.col("turn")
    heading = F.element_at(F.array(*map(F.lit, ("# Experience", "**Education**", "TECHNICAL SKILLS", "## S UMMARY", "Projects 2019 - 2021", "# Other Things"))), (n % 6 + 1).cast("int"))
    said = F.split(F.coalesce("text", F.lit("")), "(?<=[.?!]) ")
    marked = F.transform(said, lambda s, i: F.when(i % 5 == 0, F.concat(F.lit("- *"), s, F.lit("*"))).when(i % 5 == 1, F.concat(F.lit("| "), F.replace(s, F.lit(" "), F.lit(" | ")), F.lit(" |"))).when(i % 5 == 2, F.concat(F.lit("[see]("), F.lit("https://x.org/"), i, F.lit(") "), s)).otherwise(s))
    return c.select(n.alias("turn_id"), F.array_join(F.concat(F.array(F.lit("Jane Doe"), heading), marked), "\n").alias("md"))


@R.query()
def markdown_lines(spark, sf):
    """All lines of all turns, by kind and size."""
    return M.markdown_lines(turns(spark, sf), "turn_id", "md")


@R.query()
def markdown_sections(spark, sf):
    """The section of every line of every turn."""
    lines = M.markdown_lines(turns(spark, sf), "turn_id", "md")
    return M.markdown_sections(lines, ["turn_id"]).select("turn_id", "ord", "nth", "section", "heading", "is_heading")
