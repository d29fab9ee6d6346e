"""Degrees and fields of study, grades and honours, and the right to work, from lines of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgework.functions import dates as T
from sedgework.functions import values as V


def grade_of_part(part: Column) -> Column:
    """Struct of gpa and honors for a part that is nothing but a grade, a class or honours; null for others."""
    return T.let(T.spaced(part), _grade_of)


def _grade_of(p: Column) -> Column:
    whole = lambda src: F.nullif(F.trim(F.regexp_extract(p, f"(?i)^{src}$", 1)), F.lit(""))
    gpa = F.coalesce(whole(V.GRADE_FIRST), whole(V.GRADE_LAST), F.when(p.rlike(V.GRADE_CLASS), p))
    bare = F.trim(F.regexp_replace(p, V.HONORS_LABEL, ""))
    none = F.lit(None).cast("string")
    honors = T.let(bare, lambda b: F.when(b.rlike(V.HONORS), F.struct(none.alias("gpa"), b.alias("honors"))))
    return T.let(gpa, lambda g: F.when(g.isNotNull(), F.struct(g.alias("gpa"), none.alias("honors"))).otherwise(honors))


def is_note(part: Column) -> Column:
    """A minor, a concentration, a grade or honours: a property of the entry, not its subject."""
    p = F.trim(part)
    return (p != "") & (p.rlike(V.STUDY_NOTE) | grade_of_part(p).isNotNull())


def without_notes(field: Column) -> Column:
    """A field of study up to its first note; nothing if a grade leads it (a leading minor or major names a subject)."""
    cut = lambda f: F.struct(F.regexp_extract_all(f, F.lit(f"({V.STUDY_PARTS})"), 1).alias("marks"), F.split(f, V.STUDY_PARTS).alias("parts"))
    at = lambda parts: F.array_position(F.transform(parts, lambda p, i: (i > 0) & F.coalesce(is_note(p), F.lit(False))), True)
    kept = lambda parts: T.let(at(parts), lambda k: F.when(k > 0, k - 1).otherwise(F.size(parts)).cast("int"))
    return T.let(T.let(field, cut), lambda c: T.let(kept(c["parts"]), lambda k: _before_notes(c["parts"], c["marks"], k)))


def _before_notes(parts: Column, marks: Column, kept: Column) -> Column:
    joined = F.array_join(F.transform(F.slice(parts, 1, kept), lambda p, i: F.concat(p, F.when(i < kept - 1, F.coalesce(F.get(marks, i), F.lit(""))).otherwise(""))), "")
    return F.when(grade_of_part(F.get(parts, 0)).isNotNull(), "").otherwise(joined)


def field_of_study(text: Column) -> Column:
    """The subject: up to a column's break or a bar, without date, notes, a grade at its end, and marks; null if nothing is left."""
    f = F.trim(F.get(F.split(text, "\\s{2,}|\\s*\\|\\s*"), 0))
    f = without_notes(F.regexp_replace(f, V.FIELD_DATE, ""))
    f = F.trim(F.regexp_replace(f, f"(?i)\\s+(?:{V.GRADE_FIRST}|{V.GRADE_LAST})$", ""))
    return T.let(F.regexp_replace(f, "^[\\s,;:·•–\\-—]+|[\\s,;:·•–\\-—]+$", ""), T.some)


def degree_and_field(line: Column) -> Column:
    """Struct of degree and field: the credential without its subject ("Bachelor of Science", "Physics"); an empty degree if there is none."""
    return T.let(line, lambda x: T.let(F.regexp_extract(x, V.DEGREE, 0), lambda found: _degree_and_field(x, found)))


def _degree_and_field(line: Column, found: Column) -> Column:
    inside = F.regexp_extract(found, "(?i)^(.*?)\\s+in\\s+", 1)
    of = F.regexp_extract(found, "(?i)^(.*?\\bof\\s+)", 1)
    kind = F.regexp_extract(F.substring(found, F.length(of) + 1, F.length(found)), V.DEGREE_TYPE, 0)
    runs_on = (of != "") & (kind != "") & (F.trim(F.substring(found, F.length(of) + F.length(kind) + 1, F.length(found))) != "")
    ends = F.when(found.rlike("(?i)\\s+in\\s+"), F.length(inside)).when(runs_on, F.length(of) + F.length(kind)).otherwise(F.length(found))
    return T.let(ends, lambda cut: _parted(line, found, cut))


def _parted(line: Column, found: Column, cut: Column) -> Column:
    rest = F.substring(line, F.instr(line, found) + cut, F.length(line))
    for pattern in ("(?i)^\\s*(?:in|of)\\s+", "^\\s*[-–—,:·•]\\s*", "(?i)^\\s*(?:in|of)\\s+"):
        rest = F.regexp_replace(rest, pattern, "")
    return F.struct(F.trim(F.substring(found, F.lit(1), cut)).alias("degree"), F.when(found != "", field_of_study(rest)).alias("field"))


def grade_and_honors(lines: Column) -> Column:
    """Struct of gpa and honors of an entry's lines: of each the first; a labelled grade goes before a bare class in its line."""

    def one(line: Column) -> Column:
        labelled = lambda src: F.nullif(F.trim(F.regexp_extract(line, f"(?i){src}", 1)), F.lit(""))
        parts = F.transform(F.split(line, V.STUDY_PARTS), lambda p: F.regexp_replace(p, "\\s*\\b(?:19|20)[0-9]{2}\\b\\s*$", ""))
        cells = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p), F.split(p, "\\t+|\\s{2,}"))))
        hits = F.filter(F.transform(cells, grade_of_part), lambda h: h.isNotNull())
        return T.let(hits, lambda h: F.struct(F.coalesce(labelled(V.GRADE_FIRST), labelled(V.GRADE_LAST), first(h, "gpa")).alias("gpa"), first(h, "honors").alias("honors")))

    first = lambda of, name: F.get(F.filter(F.transform(of, lambda g: g[name]), lambda x: x.isNotNull()), 0)
    return T.let(F.transform(lines, one), lambda each: F.struct(first(each, "gpa").alias("gpa"), first(each, "honors").alias("honors")))


def work_authorization(text: Column) -> Column:
    """The text, with single blanks and no mark at its end, if it says that someone may work somewhere; else null."""
    return T.let(F.trim(F.regexp_replace(T.spaced(text), "[.;,]$", "")), _authorizes)


def _authorizes(t: Column) -> Column:
    said = F.lit(False)
    for p in V.STATUS_PATTERNS:
        said = said | t.rlike(f"(?i){p}")
    return F.when((t != "") & t.rlike(V.STATUS_HINT), F.when(said, t))
