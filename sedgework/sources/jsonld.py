"""Postings in the JSON-LD of pages: the JobPosting object, and its fields as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part(json: Column, path: str) -> Column:
    """A field's text (of objects and arrays, their JSON); null if missing."""
    return F.get_json_object(json, path)


def elements(json: Column) -> Column:
    """The JSON of each element of an array; of anything else an empty array."""
    return F.when(F.ltrim(json).startswith("["), F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def job_posting(json: Column) -> Column:
    """The first JobPosting of a document: itself, in its graph, or in an array of such; null if there is none."""
    is_posting = lambda j: F.coalesce(part(j, "$['@type']") == "JobPosting", F.lit(False))
    own = lambda j: F.concat(F.filter(F.array(j), is_posting), F.filter(elements(part(j, "$['@graph']")), is_posting))
    several = F.when(F.ltrim(json).startswith("["), elements(json)).otherwise(F.array(json))
    return F.get(F.flatten(F.transform(several, own)), 0)


def has_context(json: Column) -> Column:
    return F.coalesce(part(json, "$['@context']").contains("schema.org"), F.lit(False))


def place(json: Column) -> Column:
    """City, region and country of each place; several are set apart by bars."""
    whole = part(json, "$.jobLocation")
    each = F.when(F.ltrim(whole).startswith("["), elements(whole)).otherwise(F.array(whole))

    def shown(j: Column) -> Column:
        fields = F.array(*[part(j, f"$.address.{f}") for f in ("addressLocality", "addressRegion", "addressCountry")])
        named = F.array_join(F.filter(fields, lambda x: x.isNotNull() & (x != "")), ", ")
        return F.when(part(j, "$.address").isNotNull(), named).otherwise(part(j, "$.name"))

    out = F.array_join(F.filter(F.transform(each, shown), lambda x: x.isNotNull() & (x != "")), " | ")
    return F.when(out != "", out)


def work_model(json: Column) -> Column:
    """``remote`` for telecommuting, or where only the applicants' place is given."""
    kind = F.coalesce(part(json, "$.jobLocationType"), F.lit(""))
    away = (kind == "TELECOMMUTE") | kind.contains('"TELECOMMUTE"')
    return F.when(away | (part(json, "$.applicantLocationRequirements").isNotNull() & part(json, "$.jobLocation").isNull()), F.lit("remote"))


def salary(json: Column) -> Column:
    """The pay of a posting as text: a range, a least or a largest amount, or one number."""
    currency = F.coalesce(part(json, "$.baseSalary.currency"), F.lit(""))
    value = part(json, "$.baseSalary.value")
    number = lambda x: F.format_number(x.cast("bigint"), 0)
    low, high = (part(json, f"$.baseSalary.value.{k}").cast("double") for k in ("minValue", "maxValue"))
    unit = F.lower(part(json, "$.baseSalary.value.unitText"))
    low, high = F.when(low != 0, low), F.when(high != 0, high)
    return F.trim(
        F.when(value.rlike("^[0-9.]+$"), F.concat_ws(" ", currency, number(value.cast("double"))))
        .when(low.isNotNull() & high.isNotNull(), F.concat(currency, F.lit(" "), number(low), F.lit(" - "), number(high), F.coalesce(F.concat(F.lit(" per "), unit), F.lit(""))))
        .when(low.isNotNull(), F.concat(currency, F.lit(" "), number(low), F.lit("+")))
        .when(high.isNotNull(), F.concat(F.lit("Up to "), currency, F.lit(" "), number(high)))
    )


def identifier(json: Column) -> Column:
    whole = part(json, "$.identifier")
    return F.coalesce(part(json, "$.identifier.value"), part(json, "$.identifier.name"), F.when(~whole.rlike("^[\\[{]"), whole))


def postings(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, title, company, location, work_model, salary, job_id, posted, content_hash) of the rows whose JSON-LD holds a posting of schema.org."""
    rows = df.select(key, F.col(json).alias("__doc"), F.explode(F.array(job_posting(F.col(json)))).alias("__p")).where(F.col("__p").isNotNull() & (has_context(F.col("__p")) | F.col("__doc").contains("schema.org")))
    p = F.col("__p")
    hashed = F.sha2(F.concat_ws("\u0001", *[F.coalesce(part(p, f"$.{f}"), F.lit("")) for f in ("title", "description", "identifier", "jobLocation", "baseSalary", "datePosted", "validThrough")]), 256)
    return rows.select(key, F.trim(part(p, "$.title")).alias("title"), part(p, "$.hiringOrganization.name").alias("company"), place(p).alias("location"), work_model(p).alias("work_model"), salary(p).alias("salary"), identifier(p).alias("job_id"), part(p, "$.datePosted").alias("posted"), hashed.alias("content_hash"))
