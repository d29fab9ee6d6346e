"""Posting feeds: JSON of several shapes to one schema, and backups of pages as markdown text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.functions import text as X
from sedgework.functions.dates import let

#: Of each feed: the JSON schema of a job, and where the fields of a posting are.
FEEDS = {
    "remotive": ("id long, title string, company_name string, candidate_required_location string, url string, description string, publication_date string",
                 {"id": "id", "title": "title", "company": "company_name", "location": "candidate_required_location", "url": "url", "description": "description", "posted_at": "publication_date"}),
    "arbeitnow": ("slug string, title string, company_name string, location string, url string, description string, created_at long",
                  {"id": "slug", "title": "title", "company": "company_name", "location": "location", "url": "url", "description": "description", "posted_at": "created_at"}),
    "jobicy": ("id long, jobTitle string, companyName string, jobGeo string, url string, jobDescription string, pubDate string",
               {"id": "id", "title": "jobTitle", "company": "companyName", "location": "jobGeo", "url": "url", "description": "jobDescription", "posted_at": "pubDate"}),
    "lever": ("id string, text string, hostedUrl string, descriptionPlain string, createdAt long, categories struct<location:string,team:string>",
              {"id": "id", "title": "text", "company": None, "location": "categories.location", "url": "hostedUrl", "description": "descriptionPlain", "posted_at": "createdAt"}),
}


def postings(raw: DataFrame, feed: str, company: str | None = None) -> DataFrame:
    """Postings of a feed's rows (``json``): id ``<feed>:<id>``, title, company, location, url, description (plain), posted_at (ISO date), source.

    Rows without title or http(s) URL, and text that is no JSON object, go.
    """
    schema, fields = FEEDS[feed]
    rows = raw.select(F.from_json("json", schema).alias("j")).select("j.*")

    def at(name: str) -> Column:
        return F.col(fields[name]) if fields[name] else F.lit(company)

    posted = at("posted_at")
    if dict(rows.dtypes).get(fields["posted_at"]) == "bigint":
        posted = F.date_format(F.timestamp_millis(posted) if feed == "lever" else F.timestamp_seconds(posted), "yyyy-MM-dd")
    else:
        posted = F.substring(posted, 1, 10)
    out = rows.select(
        F.concat_ws(":", F.lit(feed), at("id").cast("string")).alias("id"), F.trim(at("title")).alias("title"), F.trim(F.coalesce(at("company"), F.lit(""))).alias("company"), F.coalesce(at("location"), F.lit("")).alias("location"),
        at("url").alias("url"), X.html_text(F.coalesce(at("description"), F.lit(""))).alias("description"), posted.alias("posted_at"), F.lit(feed).alias("source"),
    )
    return out.where((F.length("title") > 0) & F.lower("url").rlike("^https?://"))


def union(feeds: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def markdown_text(md: Column) -> Column:
    """Markdown without its marks, line by line: images go, links become text and address."""
    out = F.regexp_replace(md, "!\\[[^\\]]*\\]\\([^)]*\\)", "")
    out = F.regexp_replace(out, "\\[([^\\]]*)\\]\\(([^)\\s]*)[^)]*\\)", "$1 $2")
    out = F.regexp_replace(out, "<((https?://|mailto:)?[^<>\\s]+[.@][^<>\\s]+)>", "$1")
    out = F.regexp_replace(out, "(?m)^\\s{0,3}#{1,6}[ \\t]+", "")
    out = F.regexp_replace(out, "(?m)^[ \\t]*>[ \\t]?", "")
    out = F.regexp_replace(out, "[*]{2}([^*\n]+)[*]{2}", "$1")
    out = F.regexp_replace(out, "`([^`\n]+)`", "$1")
    return F.trim(out)


def link_definitions(df: DataFrame, key: str, md: str) -> DataFrame:
    """Reference definitions ``[label]: url`` of each text; of equal labels (in any case) the first."""
    pattern = "(?m)^[ ]{0,3}\\[([^\\]]+)\\]:[ \\t]*<?([^\\s>]+)>?"
    both = F.arrays_zip(F.regexp_extract_all(md, F.lit(pattern), 1).alias("label"), F.regexp_extract_all(md, F.lit(pattern), 2).alias("url"))
    rows = df.select(key, F.posexplode(both).alias("ord", "d")).select(key, "ord", F.lower("d.label").alias("label"), F.col("d.url").alias("url"))
    return rows.groupBy(key, "label").agg(F.min_by("url", "ord").alias("url"))


#: Boards of companies: the JSON schema of a job, its fields, and where departments are.
BOARDS = {
    "greenhouse": ("id long, title string, absolute_url string, updated_at string, location struct<name:string>, departments array<struct<name:string>>",
                   {"id": "id", "title": "title", "location": "location.name", "url": "absolute_url", "description": None, "html": None, "posted_at": "updated_at"}),
    "ashby": ("id string, title string, jobUrl string, publishedAt string, location string, department string, team string, descriptionPlain string, descriptionHtml string",
              {"id": "id", "title": "title", "location": "location", "url": "jobUrl", "description": "descriptionPlain", "html": "descriptionHtml", "posted_at": "publishedAt"}),
}


def board_postings(raw: DataFrame, feed: str) -> DataFrame:
    """Postings of boards' rows (slug, company, json): id ``<feed>:<slug>:<id>`` (or the URL for an id), and departments.

    An index without descriptions leaves them empty, for ``operators.boards.hydrated``. Rows without title or URL go.
    """
    schema, f = BOARDS[feed]
    rows = raw.select("slug", "company", F.from_json("json", schema).alias("j")).select("slug", "company", "j.*")
    at = lambda name: F.col(f[name]) if f[name] else F.lit(None).cast("string")
    departments = F.transform("departments", lambda d: d["name"]) if feed == "greenhouse" else F.array("department", "team")
    blank = F.lit("")
    out = rows.select(
        F.concat_ws(":", F.lit(feed), "slug", F.coalesce(at("id").cast("string"), at("url"), blank)).alias("id"), F.trim(F.coalesce(at("title"), blank)).alias("title"), "company", F.trim(F.coalesce(at("location"), blank)).alias("location"),
        F.coalesce(at("url"), blank).alias("url"), F.coalesce(at("description"), X.html_text(at("html")), blank).alias("description"), at("posted_at").alias("posted_at"), F.col("company").alias("source"),
        F.filter(F.coalesce(departments, F.array().cast("array<string>")), lambda d: d.isNotNull() & (d != "")).alias("departments"),
    )
    return out.where((F.length("title") > 0) & (F.length("url") > 0))


DEFINITION = "(?m)^ {0,3}\\[([^\\]\\n]+)\\]:[ \\t]*<?((?:[A-Za-z][A-Za-z0-9+.-]*:|www[.])[^\\s<>]*)>?[ \\t]*(?:\"[^\"]*\"|'[^']*'|\\([^)]*\\))?[ \\t]*$"
REFERENCE = "\\[[^\\]\\n]*\\](?:\\[[^\\]\\n]*\\])?"


def link_label(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, "\\s+", " ")))


def definitions(md: Column) -> Column:
    """Array of (label, url) of a text's reference definitions; of equal labels the first."""
    of = lambda k: F.regexp_extract_all(md, F.lit(DEFINITION), k)
    both = lambda labels, urls: F.transform(labels, lambda x, i: F.struct(x.alias("label"), F.get(urls, i).alias("url"), i.alias("i")))
    first = lambda labels, urls: F.filter(both(labels, urls), lambda d: F.array_position(labels, d["label"]) == d["i"] + 1)
    return let(F.transform(of(1), link_label), lambda labels: let(of(2), lambda urls: first(labels, urls)))


def resolved_links(md: Column) -> Column:
    """Markdown with its reference links as text and address, without its definitions and images that have one."""

    def target(ref: Column, found: Column) -> Column:
        """The address that a reference names, null if none."""
        second, first = F.regexp_extract(ref, "\\]\\[([^\\]]*)\\]$", 1), F.regexp_extract(ref, "^!?\\[([^\\]]*)\\]", 1)
        key = let(second, lambda s: link_label(F.when(F.trim(s) != "", s).otherwise(first)))
        return let(key, lambda k: F.get(F.transform(F.filter(found, lambda d: d["label"] == k), lambda d: d["url"]), 0))

    def without_images(body: Column, found: Column) -> Column:
        images = F.array_distinct(F.regexp_extract_all(body, F.lit(f"(!{REFERENCE})"), 1))
        return F.aggregate(images, body, lambda t, ref: F.when(target(ref, found).isNotNull(), F.replace(t, ref, F.lit(""))).otherwise(t))

    def with_links(body: Column, found: Column) -> Column:
        links = F.array_distinct(F.regexp_extract_all(body, F.lit(f"(?:^|[^!\\]])({REFERENCE})"), 1))
        shown = lambda text, url: F.when(F.trim(text) != "", F.concat(text, F.lit(" "), url)).otherwise(url)
        put = lambda t, ref, url: F.when(url.isNotNull(), F.replace(t, ref, let(F.regexp_extract(ref, "^\\[([^\\]]*)\\]", 1), lambda text: shown(text, url)))).otherwise(t)
        return F.aggregate(links, body, lambda t, ref: let(target(ref, found), lambda url: put(t, ref, url)))

    # what is used several times is bound: a lambda would compute it again for every reference
    return let(definitions(md), lambda found: let(let(F.regexp_replace(md, DEFINITION, ""), lambda b: without_images(b, found)), lambda b: with_links(b, found)))
