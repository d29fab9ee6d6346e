"""Text of positioned items: rows to lines, lines to pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions import labels as L
from sedgework.functions import values as V


def row_texts(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, font, text) of the items (x, y, width, font, str) of each row: a blank where a gap is wide and no white space is."""
    w = Window.partitionBy(*keys).orderBy("x", "str", "width")
    text = L.tight_letters(F.col("str"))
    rows = items.withColumn("__text", text)
    last, end, width, n = (F.lag(c).over(w) for c in ("__text", (F.col("x") + F.col("width")), "width", F.length("str")))
    apart = last.isNotNull() & ~last.rlike("\\s$") & ~F.col("__text").rlike("^\\s") & (F.col("x") - end > width / F.greatest(n, F.lit(1)) * V.SPACE_SHARE)
    rows = rows.withColumn("__piece", F.concat(F.when(apart, " ").otherwise(""), "__text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "str", "width", "__piece"))), lambda s: s["__piece"]), "")
    return rows.groupBy(*keys).agg(F.min("y").alias("y"), F.max("font").alias("font"), F.trim(F.regexp_replace(joined, "\\s+", " ")).alias("text"))


def page_break(keys: list[str], order: list[Column]) -> Column:
    return F.coalesce(F.lag("page").over(Window.partitionBy(*keys).orderBy(*order)) != F.col("page"), F.lit(False))


def document_text(lines: DataFrame, key: str) -> DataFrame:
    """(key, text) of lines (page, row, text): an empty line between pages, never two."""
    broken = lines.withColumn("__b", page_break([key], [F.col("page"), F.col("row")]))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "row", F.concat(F.when(F.col("__b"), "\n").otherwise(""), "text").alias("t")))), lambda s: s["t"]), "\n")
    return broken.groupBy(key).agg(L.fewer_blanks(joined).alias("text"))


def line_height(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, height): the median of the downward steps from line to line; 0 without any."""
    step = F.col("y") - F.lag("y").over(Window.partitionBy(*keys).orderBy(*order))
    steps = lines.withColumn("__s", step)
    return steps.groupBy(*keys).agg(F.coalesce(F.median(F.when(F.col("__s") > 0, F.col("__s"))), F.lit(0.0)).alias("height"))


def column_order(items: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``band``: 0 for the items of a page left of its boundary ``split`` (or without one), 1 for those right of it."""
    return items.withColumn("band", F.when(F.col("split").isNotNull() & (F.col("x") >= F.col("split")), 1).otherwise(0))


def without_icons(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items but for those of icon fonts: fonts whose texts are of one character at most and hold a private glyph."""
    icons = items.groupBy(*keys, "font_name").agg((F.max(F.length(F.trim("str"))) <= 1).alias("short"), F.bool_or(F.col("str").rlike("[\\x{E000}-\\x{F8FF}]")).alias("private"))
    return items.join(icons.where("short and private").select(*keys, "font_name"), [*keys, "font_name"], "left_anti")
