"""Contracts of records that come as JSON: what is wrong with their declared fields, and the further fields that may be kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a field may be: the test of its JSON value (a variant and its type) and its words.
KINDS = {
    "text": (lambda v, t: t.startswith("STRING") & (v.cast("string") != ""), "a non-empty string"),
    "string": (lambda v, t: t.startswith("STRING"), "a string"),
    "number": (lambda v, t: t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "a finite number"),
    "strings": (lambda v, t: t.isin("ARRAY<STRING>", "ARRAY<VOID>"), "a list of strings"),
    "object": (lambda v, t: t.startswith("OBJECT"), "an object"),
}
#: Fields of tracked records, letters and saved documents: kind, and whether they have to be there.
JOB = {"id": ("text", True), "title": ("string", True), "company": ("string", True), "status": ("text", True), "createdAt": ("number", True), "updatedAt": ("number", True), "url": ("string", False), "aliasUrls": ("strings", False), "notes": ("string", False), "deletedAt": ("number", False), "capture": ("object", False)}
LETTER = {"id": ("text", True), "jobId": ("text", True), "body": ("string", True), "createdAt": ("number", True), "updatedAt": ("number", True), "resumeId": ("string", False), "label": ("string", False)}
RESUME = {"id": ("text", True), "filename": ("text", True), "createdAt": ("number", True), "updatedAt": ("number", True), "parse": ("object", False)}

FORBIDDEN = '(?<!\\\\)"__proto__"\\s*:'


def complaint(value: Column, name: str, kind: str, required: bool) -> Column:
    """What is wrong with a field of a record (a variant); null if nothing is. A JSON null is a value."""
    test, expected = KINDS[kind]
    field = F.try_variant_get(value, f"$.{name}", "variant")
    type_ = F.coalesce(F.schema_of_variant(field), F.lit(""))
    there = F.try_variant_get(value, f"$.{name}", "variant").isNotNull()
    text = F.try_variant_get(value, f"$.{name}", "string")
    bad = ~F.coalesce(test(text, type_), F.lit(False))
    return F.when(~there, F.lit(f"`{name}` is required and must be {expected}.") if required else F.lit(None).cast("string")).when(bad, F.lit(f"`{name}` must be {expected}."))


def checked(records: DataFrame, json: str, rules: dict[str, tuple[str, bool]]) -> DataFrame:
    """Add reasons (what speaks against a record, by the rules' order) and extras (its further fields, as JSON texts; none if a record is refused).

    A text that is no JSON object, and one that holds a ``__proto__`` key anywhere, are refused whole. A null text is no record.
    """
    rows = records.withColumn("__v", F.try_parse_json(json)).withColumn("__m", F.from_json(json, "map<string,string>"))
    isobject = F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False))
    reasons = F.array_compact(F.array(*[complaint(F.col("__v"), n, k, r) for n, (k, r) in rules.items()]))
    refused = F.when(~isobject, F.array(F.lit("The record must be a JSON object."))).when(F.col(json).rlike(FORBIDDEN), F.array(F.lit("A `__proto__` key is not accepted.")))
    out = rows.withColumn("reasons", F.coalesce(refused, reasons))
    extras = F.map_filter(F.col("__m"), lambda k, _: ~k.isin(*rules))
    return out.withColumn("extras", F.when(F.size("reasons") == 0, extras)).drop("__v", "__m")
