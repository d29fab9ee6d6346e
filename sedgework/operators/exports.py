"""Whole records as documents: the open JSON schema of résumés, and markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgework.functions import credentials as C
from sedgework.functions import dates as T
from sedgework.functions import text as X

NONE = "array<string>"


def lines_of(description: Column) -> Column:
    return F.filter(F.coalesce(F.split(description, "\n"), F.array().cast(NONE)), lambda x: F.trim(x) != "")


def listed(entries: Column) -> Column:
    """Null for an empty list, which JSON then leaves out."""
    return F.when(F.size(entries) > 0, entries)


def ends(e: Column) -> Column:
    """The ISO month of an entry's end; null while it goes on."""
    return F.when(~F.coalesce(e["current"], F.lit(False)), X.iso_month(e["end"]))


def json_resume(contact: Column, summary: Column, experience: Column, education: Column, projects: Column, achievements: Column, certifications: Column, skills: Column) -> Column:
    """A record (laid out as in ``overlays``) in the open schema: basics, work, education, projects, awards, certificates, skills; empty parts are left out."""
    at = lambda k: T.some(F.try_element_at(contact, F.lit(k)))
    profile = lambda k, name: F.when(at(k).isNotNull(), F.struct(F.lit(name).alias("network"), at(k).alias("url")))
    profiles = listed(F.array_compact(F.array(profile("linkedin_url", "LinkedIn"), profile("github_url", "GitHub"))))
    place = F.when(at("location").isNotNull(), F.struct(at("location").alias("address")))
    basics = F.struct(at("full_name").alias("name"), at("headline").alias("label"), at("email").alias("email"), at("phone").alias("phone"), F.coalesce(at("website_url"), at("portfolio_url")).alias("url"), T.some(summary).alias("summary"), place.alias("location"), profiles.alias("profiles"))
    work = F.transform(experience, lambda e: F.struct(T.some(e["subtitle"]).alias("name"), T.some(e["title"]).alias("position"), T.some(e["location"]).alias("location"), X.iso_month(e["start"]).alias("startDate"), ends(e).alias("endDate"), listed(lines_of(e["description"])).alias("highlights")))

    def school(e: Column) -> Column:
        known = C.degree_and_field(F.coalesce(e["title"], F.lit("")))
        return F.struct(T.some(e["subtitle"]).alias("institution"), known["field"].alias("area"), F.coalesce(T.some(known["degree"]), T.some(e["title"])).alias("studyType"), X.iso_month(e["start"]).alias("startDate"), ends(e).alias("endDate"))

    made = F.transform(projects, lambda e: F.struct(T.some(e["title"]).alias("name"), X.iso_month(e["start"]).alias("startDate"), ends(e).alias("endDate"), listed(lines_of(e["description"])).alias("highlights")))
    award = lambda name: lambda e: F.struct(F.concat_ws(" · ", T.some(e["type"]), T.some(e["title"])).alias(name), T.some(e["year"]).alias("date"), T.some(e["description"]).alias("summary"))
    known = listed(F.transform(skills, lambda s: F.struct(s.alias("name"))))
    return F.to_json(F.struct(
        basics.alias("basics"), listed(work).alias("work"), listed(F.transform(education, school)).alias("education"), listed(made).alias("projects"), listed(F.transform(achievements, award("title"))).alias("awards"),
        listed(F.transform(certifications, award("name"))).alias("certificates"), known.alias("skills"),
    ))


def markdown(contact: Column, summary: Column, experience: Column, education: Column, projects: Column, achievements: Column, certifications: Column, skills: Column) -> Column:
    """A record as markdown: the name, a contact line, and a heading for each part that has something."""
    at = lambda k: T.some(F.try_element_at(contact, F.lit(k)))
    head = F.concat_ws("\n\n", F.concat(F.lit("# "), at("full_name")), F.nullif(F.concat_ws(" · ", at("email"), at("phone"), at("location"), at("linkedin_url"), at("github_url")), F.lit("")))

    def block(e: Column) -> Column:
        name = F.concat_ws(" — ", T.some(e["title"]), T.some(e["subtitle"]))
        dates = F.nullif(T.shown_range(e["start"], e["end"], e["current"]), F.lit(""))
        top = F.concat(F.lit("### "), F.concat_ws(" · ", F.nullif(name, F.lit("")), dates))
        return F.concat_ws("\n", top, listed_lines(lines_of(e["description"])))

    def listed_lines(lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))

    part = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), body))
    entries = lambda es: F.array_join(F.transform(es, block), "\n\n")
    awards = lambda es: F.array_join(F.transform(es, lambda e: F.concat(F.lit("- "), F.concat_ws(", ", F.concat_ws(" · ", T.some(e["type"]), T.some(e["title"])), T.some(e["year"])))), "\n")
    return F.concat_ws(
        "\n\n", T.some(head), part("Summary", T.some(summary)), part("Experience", entries(experience)), part("Education", entries(education)), part("Projects", entries(projects)), part("Achievements", awards(achievements)),
        part("Certifications", awards(certifications)), part("Skills", F.array_join(skills, ", ")),
    )
