"""What a parse has missed, told from the sections it had: verdicts on roles, schools, skills and awards, and headings that were not known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.functions import text as X
from sedgework.functions import values as V
from sedgework.operators.entries import is_bullet, sure
from sedgework.operators.sections import section_of

NONE = "array<string>"
MD_HEADING = "^#{1,3}\\s+"


def loose_reason(text: Column, section: str) -> Column:
    """Why a heading could be a section's though its name is not known: ``glyph`` before an alias, or a ``word`` that anchors it; else null."""
    aliases, anchors, _, _ = V.SECTION_NAMES[section]
    low = F.trim(F.regexp_replace(F.lower(F.trim(text)), "[:·•]+$", ""))
    bare = F.trim(F.regexp_replace(low, "^[^\\p{L}\\p{N}]+", ""))
    fits = F.length(bare).between(1, V.SECTION_CHARS)
    anchored = F.exists(X.tokens(bare), lambda t: t.isin(*anchors)) if anchors else F.lit(False)
    return F.when(fits & bare.isin(*aliases), F.when(bare != low, "glyph")).when(fits & anchored, "word")


def missed_headings(md: Column, section: str) -> Column:
    """The headings of a markdown text that could be a section's but open another or none: structs of text, strict and reason."""
    heads = F.transform(F.filter(F.split(md, "\n"), lambda x: x.rlike(MD_HEADING)), lambda x: F.trim(F.regexp_replace(x, MD_HEADING, "")))
    judged = F.transform(heads, lambda h: F.struct(h.alias("text"), section_of(h)["section"].alias("strict"), loose_reason(h, section).alias("reason")))
    return F.filter(judged, lambda h: (h["text"] != "") & h["reason"].isNotNull() & ~sure(h["strict"] == section))


def orphan_lines(md: Column, heading: Column) -> Column:
    """The lines below the first heading of a text's name, up to the next heading."""
    lines = F.split(md, "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(MD_HEADING) & (F.trim(F.regexp_replace(x, MD_HEADING, "")) == heading)), True)
    rest = F.slice(lines, (at + 1).cast("int"), F.size(lines))
    end = F.array_position(F.transform(rest, lambda x: x.rlike(MD_HEADING)), True)
    block = F.when(end > 0, F.slice(rest, F.lit(1), (end - 1).cast("int"))).otherwise(rest)
    return F.when(at > 0, F.filter(F.transform(block, F.trim), lambda x: x != "")).otherwise(F.array().cast(NONE))


def dated_lines(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(V.DATE_RANGE)))


def degrees(lines: Column) -> Column:
    return F.size(F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(f"({V.DEGREE})"), 1))


def experience_defect(entries: Column, lines: Column) -> Column:
    """No role though the section has dates, or fewer roles than lines with a range; null if nothing is wrong."""
    dated = dated_lines(lines)
    return F.when((entries == 0) & (dated > 0), "experience-parser-miss").when(entries < dated, "experience-under-segmented")


def skills_defect(entries: Column, lines: Column, missed: Column, blind: Column) -> Column:
    """``missed``: headings that could be the section's; ``blind``: there is no markdown to look for them in."""
    return F.when(entries > 0, F.lit(None).cast("string")).when(F.size(lines) > 0, "skills-extraction-miss").when(F.size(missed) > 0, "skills-header-unrecognized").when(~blind, "skills-no-section")


def education_defect(entries: Column, lines: Column, missed: Column, blind: Column) -> Column:
    none = entries == 0
    return (
        F.when(none & (F.size(lines) > 0), "education-extraction-miss").when(none & (F.size(missed) > 0), "education-header-unrecognized").when(none & ~blind, "education-no-section")
        .when(~none & (degrees(lines) > entries), "education-under-chunked")
    )


def achievements_defect(entries: Column, lines: Column) -> Column:
    heads = F.size(F.filter(lines, lambda x: ~is_bullet(x)))
    return F.when((entries == 0) & (F.size(lines) > 0), "achievements-parser-miss").when(entries < heads, "achievements-under-segmented").when(entries == 0, "achievements-no-section")


def defects(documents: DataFrame, sections: DataFrame, entries: DataFrame, key: str, md: str) -> DataFrame:
    """(key, defects, missed): what a parse of each document has missed.

    ``documents`` has the key and the markdown (null: none); ``sections`` (key, section, lines) are those of ``sections.by_name``, ``entries`` (key, section, n) how many
    entries of each were parsed. ``missed`` are the unknown headings (section: text); a document without sections has all defects of absence.
    """
    names = ("experience", "education", "skills", "achievements")
    lines = sections.where(F.col("section").isin(*names)).groupBy(key).pivot("section", list(names)).agg(F.first("lines")).withColumnsRenamed({n: f"{n}_lines" for n in names})
    counts = entries.where(F.col("section").isin(*names)).groupBy(key).pivot("section", list(names)).agg(F.sum("n")).withColumnsRenamed({n: f"{n}_n" for n in names})
    rows = documents.select(key, F.col(md).alias("__md")).join(lines, key, "left").join(counts, key, "left")
    rows = rows.withColumns({f"{n}_lines": F.coalesce(f"{n}_lines", F.array().cast(NONE)) for n in names} | {f"{n}_n": F.coalesce(f"{n}_n", F.lit(0)) for n in names})
    rows = rows.withColumn("blind", F.trim(F.coalesce("__md", F.lit(""))) == "")
    for n in ("skills", "education"):
        rows = rows.withColumn(f"{n}_missed", F.explode(F.array(missed_headings(F.coalesce("__md", F.lit("")), n))))
    c = lambda n, what: F.col(f"{n}_{what}")
    found = F.array_compact(F.array(
        experience_defect(c("experience", "n"), c("experience", "lines")), skills_defect(c("skills", "n"), c("skills", "lines"), c("skills", "missed"), F.col("blind")),
        education_defect(c("education", "n"), c("education", "lines"), c("education", "missed"), F.col("blind")), achievements_defect(c("achievements", "n"), c("achievements", "lines")),
    ))
    named = lambda n: F.transform(c(n, "missed"), lambda h: F.concat(F.lit(f"{n}: "), h["text"]))
    return rows.select(key, found.alias("defects"), reduce(F.concat, (named("skills"), named("education"))).alias("missed"))
