"""Records of schools, projects and the right to work, from entries and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.functions import credentials as C
from sedgework.functions import dates as T
from sedgework.functions import shapes as H
from sedgework.functions import values as V

URL = "(?i)\\b(?:https?://|www[.])?[a-z0-9-]+(?:[.][a-z0-9-]+)*[.][a-z]{2,}(?:/[^\\s|,;)]*)?"


def education(blocks: DataFrame) -> DataFrame:
    """``blocks`` of a school section (header_lines, start, end, body) with institution, degree, field, gpa, honors, dates.

    The institution is the first head line (or part of one) that names a school; degree and field come from the first that names a degree, or from the
    body; grades from all lines. Dates are read as a school's: a lone date is the end. Entries without institution and degree are dropped.
    """
    none = F.array().cast("array<string>")
    lines = F.concat(F.coalesce("header_lines", none), F.coalesce(F.split("body", "\n"), none))
    rows = blocks.withColumn("__l", F.explode(F.array(lines)))
    parts = F.flatten(F.transform("__l", lambda x: F.split(x, "\\s+[|·—–]\\s+|\\s{2,}|,\\s+")))
    school = F.get(F.filter(parts, lambda p: H.has_word(p, V.SCHOOL_WORDS)), 0)
    with_degree = F.get(F.filter("__l", lambda x: x.rlike(V.DEGREE)), 0)
    known = C.degree_and_field(with_degree)
    rows = rows.withColumns({"institution": T.let(T.without_dates(school), T.some), "__d": F.explode(F.array(known))})
    rows = rows.withColumn("__g", F.explode(F.array(C.grade_and_honors(F.col("__l")))))
    dates = T.education_dates(F.concat_ws(" ", "start", F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), "-"), "end"))
    rows = rows.withColumns({"degree": T.some(F.col("__d.degree")), "field": F.col("__d.field"), "gpa": F.col("__g.gpa"), "honors": F.col("__g.honors"), "dates": dates})
    return rows.where("institution IS NOT NULL OR degree IS NOT NULL").drop("__l", "__d", "__g")


def lifted_label(lines: Column) -> Column:
    """Struct of label and url: the first head line without the first link that stands alone in the head."""
    whole = F.array_join(lines, " ")
    hits = F.regexp_extract_all(whole, F.lit(f"({URL})"), 1)
    url = F.get(F.filter(hits, lambda u: H.is_standalone_url(u, whole) & H.is_website(u)), 0)
    first = F.coalesce(F.get(lines, 0), F.lit(""))
    bare = F.when(url.isNotNull(), F.replace(first, url, F.lit(""))).otherwise(first)
    return F.struct(F.trim(F.regexp_replace(bare, "[\\s|•·\\-–—]+$", "")).alias("label"), url.alias("url"))


def projects(blocks: DataFrame) -> DataFrame:
    """``blocks`` that a first line opens, as projects: name, url, start, end, current, description, confidence; blocks without a name are dropped."""
    rows = blocks.withColumn("__h", F.explode(F.array(lifted_label(F.coalesce("header_lines", F.array().cast("array<string>"))))))
    points = [(F.col("__h.label") != "", V.PROJECT_POINTS["name"]), (F.col("start").isNotNull(), V.PROJECT_POINTS["date"]), (F.col("bullets") > 0, V.PROJECT_POINTS["bullet"])]
    score = F.round(reduce(lambda a, b: a + b, [F.when(c, F.lit(p)).otherwise(0.0) for c, p in points]), 6)
    rows = rows.withColumns({"name": F.col("__h.label"), "url": F.col("__h.url"), "description": F.col("body"), "confidence": score})
    return rows.where("name <> ''").drop("__h")


def work_authorizations(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): the first part of a line (between bars and dots) that says that someone may work somewhere."""
    parts = lines.select(*keys, "ord", F.posexplode(F.split("text", "[·•∙|｜]")).alias("part", "said"))
    found = parts.withColumn("status", C.work_authorization(F.col("said"))).where("status IS NOT NULL")
    return found.groupBy(*keys).agg(F.min(F.struct("ord", "part", "status"))["status"].alias("status"))
