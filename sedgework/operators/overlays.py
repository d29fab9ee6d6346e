"""Edits laid over whole records: fields, bullets, added and removed entries, as one projection.

A record is a row: contact (map), confidence (map), summary, the five arrays of entries, skills, and lines (its raw text). An edit
is a row of the same key; all of its parts are optional. Entries are named by ``section:index`` of the record as it was, so
entries go last. Nothing is exploded: nested arrays are changed in place, and a row stays a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.functions import dates as T
from sedgework.functions import shapes as H
from sedgework.functions import text as X

SECTIONS = ("experience", "education", "projects", "achievements", "certifications")
FIELDS = ("title", "subtitle", "location", "team", "type", "year", "start", "end")
ENTRY = "struct<title:string,subtitle:string,location:string,team:string,type:string,year:string,start:string,end:string,current:boolean,description:string>"
RECORD = {"contact": "map<string,string>", "confidence": "map<string,double>", "summary": "string", **dict.fromkeys(SECTIONS, f"array<{ENTRY}>"), "skills": "array<string>", "lines": "array<string>"}
EDIT = {
    "e_contact": "map<string,string>", "e_summary": "string", "e_fields": "map<string,string>", "e_bullets": "array<struct<bullet:string,text:string>>", "e_removed_bullets": "array<string>", "e_descriptions": "map<string,string>",
    "e_added": f"array<struct<id:string,section:string,entry:{ENTRY}>>", "e_added_bullets": "map<string,array<string>>", "e_removed": "array<string>", "e_skills_removed": "array<string>", "e_skills_added": "array<string>",
}


def laid_over(values: Column, edits: Column) -> Column:
    """A map with the edits' values; an edit's empty value takes the key away, the map's own stay as they are."""
    kept = F.map_filter(values, lambda k, _: ~F.map_contains_key(edits, k))
    return F.map_concat(kept, F.map_filter(edits, lambda _, v: v.isNull() | (v != "")))


def edited(value: Column, edits: Column, key: Column) -> Column:
    """A value, or what the edits have for its key; an empty edit clears it."""
    return F.when(F.map_contains_key(edits, key), F.nullif(F.try_element_at(edits, key), F.lit(""))).otherwise(value)


def entry(parts: dict[str, Column]) -> Column:
    names = (*FIELDS, "current", "description")
    return F.struct(*[parts[n].cast("boolean" if n == "current" else "string").alias(n) for n in names])


def edited_entries(entries: Column, section: str, fields: Column, descriptions: Column) -> Column:
    """A section's entries with edited fields and descriptions; an experience whose dates were edited keeps the editor's rule for dates."""

    def one(e: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{section}:"), i)
        parts = {f: edited(e[f], fields, F.concat(at, F.lit(f":{f}"))) for f in FIELDS} | {"current": e["current"], "description": edited(e["description"], descriptions, at)}
        if section == "experience":
            dated = F.map_contains_key(fields, F.concat(at, F.lit(":start"))) | F.map_contains_key(fields, F.concat(at, F.lit(":end")))
            settled = T.settled_dates(parts["start"], parts["end"], F.nullif(parts["end"], F.lit("")).isNull() & e["current"])
            parts |= {k: F.when(dated, settled[k]).otherwise(parts[k]) for k in ("start", "end", "current")}
        return entry(parts)

    return F.transform(entries, one)


def first_match(groups: Column, key: Column) -> Column:
    """The number of the first group that has a line of a key; 0 if none has."""
    return F.array_position(F.transform(groups, lambda g: F.exists(g, lambda x: X.bullet_key(x) == key)), True)


def changed_lines(groups: Column, edits: Column, bullet, text) -> Column:
    """Lines in groups after edits in their order: each changes the first line that says its bullet, or drops it where its text is null."""

    def step(all_: Column, e: Column) -> Column:
        key = X.bullet_key(bullet(e))
        hit = first_match(all_, key)
        new = text(e)

        def group(g: Column, i: Column) -> Column:
            at = F.array_position(F.transform(g, lambda x: X.bullet_key(x) == key), True)
            put = F.transform(g, lambda x, j: F.when(j + 1 == at, new).otherwise(x))
            return F.when(i + 1 == hit, F.filter(put, lambda x: x.isNotNull())).otherwise(g)

        return F.when(hit > 0, F.transform(all_, group)).otherwise(all_)

    return F.aggregate(edits, groups, step)


def described(e: Column, text: Column) -> Column:
    return entry({f: e[f] for f in (*FIELDS, "current")} | {"description": text})


def with_bullets(entries: Column, section: str, added: Column) -> Column:
    """Entries with the bullets that were added to them behind their descriptions."""
    return F.transform(entries, lambda e, i: described(e, T.some(F.array_join(F.concat(F.array(e["description"]), F.coalesce(F.try_element_at(added, F.concat(F.lit(f"{section}:"), i)), F.array().cast("array<string>"))), "\n"))))


def named(section: str, i: Column) -> Column:
    return F.concat(F.lit(f"{section}:"), i)


def keys_of(entries: Column, section: str) -> Column:
    return F.transform(entries, lambda _, i: named(section, i))


def of_section(added: Column, section: str) -> Column:
    return F.filter(added, lambda a: a["section"] == section)


def removed_titles(entries: Column, section: str, removed: Column) -> Column:
    keyed = F.transform(entries, lambda e, i: F.struct(named(section, i).alias("k"), e["title"].alias("t")))
    return F.transform(F.filter(keyed, lambda z: F.array_contains(removed, z["k"])), lambda z: z["t"])


def without_removed(entries: Column, section: str, removed: Column) -> Column:
    return F.filter(entries, lambda _, i: ~F.array_contains(removed, named(section, i)))


def without_line(lines: Column, title: Column) -> Column:
    """Lines but for the first that an entry's title owns."""
    at = F.array_position(F.transform(lines, lambda x: H.owned_by_title(x, title)), True)
    return F.when(T.some(title).isNotNull(), F.filter(lines, lambda x, j: j + 1 != at)).otherwise(lines)


def applied(records: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """``records`` with their ``edits`` (at most one row a key); records without any come back as they are.

    Parts that are null or columns that are missing mean nothing of a record or no edit. Order: contact and summary, fields, bullets
    (in order, so that a second edit finds the first one's text), removed bullets, descriptions, skills, added entries and
    bullets, removed entries (none of those that were added). Further columns of records stay; those of edits are not read.
    """
    rows = records.join(edits.select(F.col(key), *[F.col(n.removeprefix("e_")).alias(n) for n in EDIT if n.removeprefix("e_") in edits.columns], F.lit(True).alias("__edited")), key, "left")
    return applied_rows(rows, "__edited").drop("__edited")


def applied_rows(rows: DataFrame, edited_if: str) -> DataFrame:
    """As ``applied``, for records whose edits (columns ``e_<part>``) are in their own row, so that keys may repeat; ``edited_if`` is the column that says whether there are any."""
    given = [c for c in rows.columns if c not in EDIT]
    have = set(given)
    rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in RECORD.items() if n not in have} | {n: F.col(n).cast(t) if n in rows.columns else F.lit(None).cast(t) for n, t in EDIT.items()} | {"__edited": F.coalesce(edited_if, F.lit(False))})
    empty = {n: (F.create_map() if t.startswith("map") else F.array()).cast(t) for n, t in (RECORD | EDIT).items() if t != "string"}
    rows = rows.withColumns({n: F.coalesce(n, e) for n, e in empty.items()})
    lines_of = lambda c: F.transform(c, lambda e: F.coalesce(F.split(e["description"], "\n"), F.array().cast("array<string>")))
    said = {"bullet": lambda e: e["bullet"], "text": lambda e: F.trim(e["text"])}
    real = F.filter("e_bullets", lambda e: (F.trim(e["text"]) != "") & (F.trim(e["text"]) != e["bullet"]))
    drop = {"bullet": lambda e: e, "text": lambda _: F.lit(None).cast("string")}
    change = lambda groups: changed_lines(changed_lines(groups, real, said["bullet"], said["text"]), F.col("e_removed_bullets"), drop["bullet"], drop["text"])

    out = {"contact": laid_over(F.col("contact"), F.col("e_contact")), "summary": F.when(F.col("e_summary").isNull(), F.col("summary")).otherwise(F.when(F.trim("e_summary") != "", F.col("e_summary")))}
    out["confidence"] = F.map_concat(F.map_filter("confidence", lambda k, _: ~F.map_contains_key("e_contact", k)), F.transform_values("e_contact", lambda _, v: F.when(v == "", 0.0).otherwise(1.0)))
    gone = lambda x: F.array_contains("e_skills_removed", F.lower(F.trim(x)))
    kept = F.filter("skills", lambda x: ~gone(x))
    fresh = F.filter("e_skills_added", lambda x: (F.trim(x) != "") & ~F.exists(kept, lambda s: F.lower(F.trim(s)) == F.lower(F.trim(x))))
    out["skills"] = F.concat(kept, F.aggregate(fresh, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda s: F.lower(F.trim(s)) == F.lower(F.trim(x))), a).otherwise(F.concat(a, F.array(F.trim(x))))))
    out["lines"] = F.get(change(F.array("lines")), 0)
    for s in SECTIONS:
        base = F.col(s)
        if s == "experience":  # a bullet belongs to a role
            base = F.transform(F.arrays_zip(base.alias("e"), change(lines_of(base)).alias("d")), lambda z: described(z["e"], F.when(z["e"]["description"].isNotNull(), T.some(F.array_join(z["d"], "\n")))))
        out[s] = edited_entries(base, s, F.col("e_fields"), F.col("e_descriptions"))
    rows = rows.withColumns({n: F.when(F.col("__edited"), c).otherwise(F.col(n)) for n, c in out.items()})

    # what was added, then what was removed
    none = F.array().cast("array<string>")
    there = F.flatten(F.array(*[keys_of(F.col(s), s) for s in SECTIONS if s != "education"]))
    marked = F.concat(F.flatten(F.transform("e_added", lambda a: F.coalesce(F.try_element_at("e_added_bullets", a["id"]), none))), F.flatten(F.map_values(F.map_filter("e_added_bullets", lambda k, _: F.array_contains(there, k)))))
    text = lambda a: T.some(F.array_join(F.coalesce(F.try_element_at("e_added_bullets", a["id"]), F.array().cast("array<string>")), "\n"))

    def new(a: Column) -> Column:
        e, span = a["entry"], T.settled_dates(a["entry"]["start"], a["entry"]["end"], F.lit(False))
        role = a["section"] == "experience"
        parts = {f: T.some(e[f]) for f in FIELDS} | {"current": F.coalesce(e["current"], F.lit(False)), "description": F.when(a["section"] != "education", text(a))}
        return entry(parts | {k: F.when(role, span[k]).otherwise(parts[k]) for k in ("start", "end", "current")})

    grown = {}
    for s in SECTIONS:
        whole = with_bullets(F.col(s), s, F.col("e_added_bullets")) if s != "education" else F.col(s)
        grown[s] = F.concat(whole, F.transform(of_section(F.col("e_added"), s), new))
    pool = F.transform(F.filter(marked, lambda b: b.isNotNull()), lambda b: F.concat(F.lit("• "), b))
    grown["lines"] = F.concat("lines", pool)
    # numbers are those of the record as it was: none names an entry that was added
    grown["e_removed"] = F.array_intersect("e_removed", F.flatten(F.array(*[keys_of(F.col(s), s) for s in SECTIONS])))
    rows = rows.withColumns({n: F.when(F.col("__edited"), c).otherwise(F.col(n)) for n, c in grown.items()})
    lost = F.flatten(F.array(*[removed_titles(F.col(s), s, F.col("e_removed")) for s in SECTIONS]))
    left = {s: without_removed(F.col(s), s, F.col("e_removed")) for s in SECTIONS}
    left["lines"] = F.aggregate(lost, F.col("lines"), without_line)
    rows = rows.withColumns({n: F.when(F.col("__edited"), c).otherwise(F.col(n)) for n, c in left.items()})
    return rows.select(*given, *[n for n in RECORD if n not in have])
