"""Columns of pages from the places of their items: gutters, embedded grids, and lines in reading order.

A page's items are projected on the x axis in strips; the widest corridor that hardly any row paints, between two
real columns, is its gutter. Grids inside of a column (rows that are parted by wide gaps, one under the other) are
read column by column. A page is the unit of every window and list.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from sedgework.functions import dates as T
from sedgework.functions import labels as L
from sedgework.functions import values as V
from sedgework.operators.entries import once, sure


def null_safe(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on])
    return a.alias("a").join(b.alias("b"), same, how).select("a.*", *[F.col(f"b.{c}") for c in b.columns if c not in on])


def row_tops(y: np.ndarray) -> list[float]:
    """Where rows begin: a row takes heights up to ``ROW_GAP`` below its first."""
    tops: list[float] = []
    for at in np.unique(y).tolist():
        if not tops or not at - tops[-1] <= V.ROW_GAP:
            tops.append(at)
    return tops


@F.pandas_udf(DoubleType())
def gutter(xs: pd.Series, ys: pd.Series, widths: pd.Series, pages: pd.Series) -> pd.Series:
    """The middle of each page's gutter, null without one; a page's items are its lists of places."""
    return pd.Series([page_gutter(*map(np.asarray, p[:3]), p[3]) for p in zip(xs, ys, widths, pages, strict=True)], dtype="float64")


def page_gutter(x: np.ndarray, y: np.ndarray, width: np.ndarray, page: float) -> float | None:
    starts = row_tops(y)
    if len(x) < V.COLUMN_ITEMS or len(starts) < 2 * V.COLUMN_ROWS:
        return None
    row = np.searchsorted(starts, y, side="right") - 1
    last = math.ceil(page / V.STRIP) - 1
    low, high = math.floor(page * V.GUTTER_BAND[0] / V.STRIP), min(math.ceil(page * V.GUTTER_BAND[1] / V.STRIP), last)
    if low > high:
        return None
    # a row's items paint the strips that they touch; each strip counts a row once
    a, b = np.maximum(np.floor(x / V.STRIP), low).astype(int) - low, np.minimum(np.floor((x + width) / V.STRIP), high).astype(int) - low
    inside, across = a <= b, high - low + 2
    begun, ended = (np.bincount(row[inside] * across + at[inside], minlength=len(starts) * across) for at in (a, b + 1))
    on = (begun - ended).reshape(len(starts), across)
    crossed = (np.cumsum(on, axis=1)[:, :-1] > 0).sum(axis=0)
    free = np.concatenate(([False], crossed / len(starts) <= V.GUTTER_COVERAGE, [False])).astype(int)
    edges = np.diff(free)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(begin):
        return None
    best = int(np.argmax(end - begin))  # of equal ones the first
    if (end[best] - begin[best]) * V.STRIP < page * V.GUTTER_WIDTH:
        return None
    split = (2 * low + begin[best] + end[best] - 1) / 2 * V.STRIP
    enough = all(np.count_nonzero(np.bincount(row[side])) >= V.COLUMN_ROWS for side in (x < split, x >= split))
    return float(split) if enough else None


@F.pandas_udf(StructType([StructField("left", IntegerType()), StructField("rows", ArrayType(ArrayType(IntegerType())))]))
def page_rows(xs: pd.Series, ys: pd.Series, widths: pd.Series, pages: pd.Series, splits: pd.Series) -> pd.DataFrame:
    """The numbers of the items of each page's rows, from the top, and how many rows are left of its gutter; the others are right of it.

    A page's gutter is found where the page's width is given, else it is ``splits`` (null: none).
    """
    out = []
    for x, y, width, page, split in zip(xs, ys, widths, pages, splits, strict=True):
        x, y = np.asarray(x, dtype="float64"), np.asarray(y, dtype="float64")
        at = (None if pd.isna(split) else split) if pd.isna(page) else page_gutter(x, y, np.asarray(width, dtype="float64"), page)
        right = np.zeros(len(x), dtype=bool) if at is None else ~(x < at)
        sides = [side_rows(np.flatnonzero(side), y) for side in (~right, right)]
        out.append((len(sides[0]), sides[0] + sides[1]))
    return pd.DataFrame(out, columns=["left", "rows"])


def side_rows(items: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    if not len(items):
        return []
    row = np.searchsorted(row_tops(y[items]), y[items], side="right") - 1
    items, ends = items[np.argsort(row, kind="stable")].astype("int32"), np.cumsum(np.bincount(row)).tolist()
    return [items[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def page_width(items: DataFrame) -> Column:
    return F.max(F.col("page_width").cast("double")) if "page_width" in items.columns else F.lit(None).cast("double")


def some_width(width: Column) -> Column:
    return F.when(width > 0, width).otherwise(V.PAGE_WIDTH).cast("double")


def column_boundaries(items: DataFrame, pages: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, split) of the pages that have two columns: the middle of the gutter.

    ``items`` has the keys (of a page), x, y, width; ``pages`` the keys and the page's width (None: the items' ``page_width``). A gutter is the widest run of strips in the
    middle of the page that at most four rows in a hundred paint (of equal ones the first), with four rows on both sides; pages of
    few items have none. Items without a place are left out. A page's items are put together once, and nothing else of them is shuffled.
    """
    place = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce(F.col("width"), F.lit(0)).cast("double").alias("width"))
    whole = items.groupBy(*keys).agg(F.collect_list(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), place)).alias("__p"), page_width(items).alias("__w"))
    if pages is not None:
        widths = pages.select(*keys, F.col("width").cast("double").alias("page_width")).groupBy(*keys).agg(F.max("page_width").alias("page_width"))
        whole = null_safe(whole.drop("__w"), widths, keys, "left").withColumnRenamed("page_width", "__w")
    return whole.select(*keys, gutter("__p.x", "__p.y", "__p.width", some_width(F.col("__w"))).alias("split")).where("split IS NOT NULL")


def layout(pages: DataFrame, boundaries: DataFrame, document: list[str]) -> DataFrame:
    """(document, scanned, two_column, triggers): what stands against reading a document's pages.

    ``pages`` has the document, page and chars; a document is scanned if its pages have fewer than 80 characters each on average,
    and columns of such a document don't count.
    """
    two = boundaries.select(*document).distinct().withColumn("two", F.lit(True))
    found = pages.groupBy(*document).agg((F.avg(F.coalesce("chars", F.lit(0))) < V.SCANNED_CHARS).alias("scanned"))
    found = null_safe(found, two, document, "left").withColumn("two_column", ~F.col("scanned") & F.coalesce("two", F.lit(False)))
    triggers = F.array_compact(F.array(F.when(F.col("scanned"), "scanned"), F.when(F.col("two_column"), "two_column")))
    return found.select(*document, "scanned", "two_column", triggers.alias("triggers"))


def pieces(items: DataFrame, by: list[str]) -> DataFrame:
    """Add ``piece`` to the items of a row: its text, with a blank before it where a gap is wide and no white space is."""
    w = Window.partitionBy(*by).orderBy("x", "str", "width")
    items = items.withColumn("__t", L.tight_letters(F.col("str")))
    last, end, width, n = (F.lag(c).over(w) for c in ("__t", F.col("x") + F.col("width"), "width", F.length("str")))
    apart = last.isNotNull() & ~last.rlike("\\s$") & ~F.col("__t").rlike("^\\s") & (F.col("x") - end > width / F.greatest(n, F.lit(1)) * V.SPACE_SHARE)
    return items.withColumns({"piece": F.concat(F.when(apart, " ").otherwise(""), "__t"), "gap": F.col("x") - end}).drop("__t")


def merged(parts: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(parts, ""), "\\s+", " "))


def rows_of_pages(items: DataFrame, boundaries: DataFrame | None, page: list[str]) -> DataFrame:
    """(page, band, row, items): a row's items by place, of the left band first; ``page`` names the keys of a page."""
    text = F.coalesce("str", F.lit(""))
    items = items.select(*page, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "font")], F.coalesce(F.col("width"), F.lit(0)).cast("double").alias("width"), text.alias("str"), L.tight_letters(text).alias("tight"), *(["page_width"] if "page_width" in items.columns else []))
    # what is read off an item alone is read before the items of a page are put together, and its text is carried twice only where it changes
    space = F.col("width") / F.greatest(F.length("str"), F.lit(1)) * V.SPACE_SHARE
    item = F.struct("x", "str", "width", "y", "font", F.when(F.col("tight") != F.col("str"), F.col("tight")).alias("tight"), F.col("tight").rlike("\\s$").alias("ends"), F.col("tight").rlike("^\\s").alias("begins"), (F.col("x") + F.col("width")).alias("end"), space.alias("space"))
    whole = items.groupBy(*page).agg(F.collect_list(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), item)).alias("__items"), page_width(items).alias("__w"))
    none = F.lit(None).cast("double")
    width, split = (some_width(F.col("__w")), none) if boundaries is None else (none, F.col("split").cast("double"))
    whole = whole if boundaries is None else null_safe(whole, boundaries.select(*page, "split"), page, "left")
    whole = whole.select(*page, "__items", page_rows("__items.x", "__items.y", "__items.width", width, split).alias("__r"))
    left = F.col("__r.left")
    row = lambda at, i: F.struct(
        (i >= left).cast("int").alias("band"), (i + 1 - F.when(i >= left, left).otherwise(0)).alias("row"), F.sort_array(F.transform(at, lambda k: F.get("__items", k))).alias("items")
    )
    return whole.select(*page, F.explode(F.transform("__r.rows", row)).alias("__e")).select(*page, "__e.*")


def row_parts(rows: DataFrame) -> DataFrame:
    """Rows with ``cells`` (how often they are cut) and ``parts`` in the place of ``items``: their pieces by cell, or one part of a row that isn't cut."""

    def piece(s: Column, i: Column) -> Column:
        last, text = F.get("items", i - 1), F.coalesce(s["tight"], s["str"])
        apart = (s["x"] - last["end"] > last["space"]) & ~last["ends"] & ~s["begins"]
        return F.struct(s["x"].alias("x"), s["y"].alias("y"), s["font"].alias("font"), F.when(apart, F.concat(F.lit(" "), text)).otherwise(text).alias("piece"), sure(s["x"] - last["end"] > V.COLUMN_GAP).alias("wide"))

    rows = once(rows, __p=F.transform("items", piece)).drop("items")
    at = F.array_compact(F.transform("__p", lambda p, i: F.when(p["wide"], i)))
    rows = once(rows, __at=F.when(F.array_contains("__p.wide", True), at).otherwise(F.array().cast("array<int>")))
    # a range of dates alone in the last cell belongs to the cell before it
    tail = merged(F.slice("__p.piece", F.element_at("__at", -1) + 1, F.size("__p")))
    dated = F.when(F.size("__at") > 0, sure(T.let(tail, lambda t: T.is_lone_range(t)))).otherwise(False)
    rows = once(rows, __cuts=F.when(dated, F.slice("__at", 1, F.size("__at") - 1)).otherwise(F.col("__at"))).drop("__at")
    parts = F.transform("__p", lambda p, i: F.struct(F.size(F.filter("__cuts", lambda c: c <= i)).alias("cell"), p["x"].alias("x"), p["y"].alias("y"), p["font"].alias("font"), p["piece"].alias("piece")))
    return rows.withColumns({"cells": F.size("__cuts"), "parts": F.when(F.size("__cuts") == 0, F.array(F.struct(F.lit(0).alias("cell"), *united(F.col("__p"), "piece")))).otherwise(parts)}).drop("__p", "__cuts")


def united(parts: Column, text: str) -> list[Column]:
    """The place, font and text of some pieces together."""
    y = F.aggregate(parts["y"], F.lit(0.0), lambda a, y: a + y) / F.size(parts)
    return [F.array_min(parts["x"]).alias("x"), y.alias("y"), F.array_max(parts["font"]).alias("font"), merged(parts["piece"]).alias(text)]


def lines(items: DataFrame, boundaries: DataFrame | None, document: list[str]) -> DataFrame:
    """The lines of documents in reading order: (document, ord, page, band, x, y, font, text, gap).

    ``items`` has the document, page, x, y, width, font, str; ``boundaries`` the document, page and split of two-column pages, whose left
    column is read first. A row is cut where a gap is wider than a column's, but a range of dates at its end stays. Two rows or more,
    one under the other, that are so cut are a grid and are read column by column. ``gap`` is the step down from the line above on
    the page, 0 where there is none. Null texts are empty. Without ``boundaries`` they are found (in items' ``page_width``, where they have it). A page's
    items are put together once and parted into rows; windows and the shuffle by document see rows, not items.
    """
    page = [*document, "page"]
    band = [*page, "band"]
    rows = row_parts(rows_of_pages(items, boundaries, page)).repartition(*document)
    # grids: runs of rows with cells
    rows = rows.withColumn("cut", F.col("cells") > 0)
    rows = rows.withColumn("island", F.col("row") - F.row_number().over(Window.partitionBy(*band, "cut").orderBy("row")))
    run = Window.partitionBy(*band, "cut", "island")  # its rows follow each other
    rows = rows.withColumn("grid", F.when(F.col("cut") & (F.count("*").over(run) >= V.GRID_ROWS), F.min("row").over(run)))
    rows = rows.withColumn("xs", F.collect_list(F.when(F.col("grid").isNotNull(), F.col("parts.x"))).over(Window.partitionBy(*band, "grid")))
    rows = once(rows, __xs=F.sort_array(F.flatten("xs"))).drop("xs")
    jumps = F.filter("__xs", lambda x, i: sure(x - F.get("__xs", i - 1) > V.COLUMN_GAP))
    rows = once(rows, __jumps=F.coalesce(jumps, F.array().cast("array<double>"))).drop("__xs")
    # in a grid a row's cells are cut again within its column
    keyed = F.transform("parts", lambda p: F.struct(F.struct(F.size(F.filter("__jumps", lambda j: j <= p["x"])).alias("column"), p["cell"].alias("cell")).alias("of"), p.alias("p")))
    rows = once(rows, __k=F.when(F.col("cut"), keyed))
    place = lambda k: T.let(F.transform(F.filter("__k", lambda z: z["of"] == k), lambda z: z["p"]), lambda g: F.struct(k["column"].alias("column"), k["cell"].alias("cell"), *united(g, "text")))
    whole = F.transform("parts", lambda p: F.struct(F.lit(0).alias("column"), p["cell"].alias("cell"), p["x"].alias("x"), p["y"].alias("y"), p["font"].alias("font"), p["piece"].alias("text")))
    cut = F.transform(F.array_distinct(F.col("__k.of")), place)
    found = rows.select(*band, F.coalesce("grid", "row").alias("top"), "row", F.explode(F.when(F.col("cut"), cut).otherwise(whole)).alias("__l")).select(*band, "top", "row", "__l.*")
    order = Window.partitionBy(*document).orderBy("page", "band", "top", "column", "row", "cell")
    step = F.when(F.lag("page").over(order) == F.col("page"), F.col("y") - F.lag("y").over(order))
    return found.select(*document, (F.row_number().over(order) - 1).alias("ord"), "page", "band", "x", "y", "font", "text", F.when(step > 0, step).otherwise(0.0).alias("gap"))


def flush_right(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, head, trailer) of rows that a wide blank item parts; rows without one inside are not returned."""
    w = Window.partitionBy(*by).orderBy("x", "str", "width")
    rows = pieces(items, by).withColumns({"n": F.row_number().over(w), "of": F.count("*").over(Window.partitionBy(*by))})
    blank = (F.trim("str") == "") & (F.col("width") > V.COLUMN_GAP) & (F.col("n") > 1) & (F.col("n") < F.col("of"))
    rows = rows.withColumn("at", F.min(F.when(blank, F.col("n"))).over(Window.partitionBy(*by))).where("at is not null")
    side = lambda c: merged(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("n", "piece")))), lambda s: s["piece"]))
    return rows.groupBy(*by).agg(side(F.col("n") < F.col("at")).alias("head"), side(F.col("n") > F.col("at")).alias("trailer"))
