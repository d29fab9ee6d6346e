"""Queries over small text forms and over postings in JSON-LD; parts and orders make the inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgework.functions import labels as L
from sedgework.functions import values as V
from sedgework.plans import sql
from sedgework.plans.registry import Registry
from sedgework.sources import jsonld
from sedgework.sources.tables import as_view, table

R = Registry()
N = "CAST(p_partkey * p_partkey * 37 % 5000000 AS BIGINT)"
NAME = "CASE p_partkey % 4 WHEN 0 THEN ' ' || p_name || '  O''Neil ' WHEN 1 THEN p_brand || ' (' || p_type || ')' WHEN 2 THEN '' ELSE 'Zoe-' || p_name END"
STATUS = "CASE p_partkey % 5 WHEN 0 THEN 'saved' WHEN 1 THEN 'withdrawn' WHEN 2 THEN 'applied' WHEN 3 THEN 'Shared' ELSE p_type END"
SPACED = "CASE p_partkey % 4 WHEN 0 THEN 'S kills and E xperience' WHEN 1 THEN 'J O H N  D O E ' || p_name WHEN 2 THEN 'a b c ' || p_name ELSE 'W O R K at ' || p_name END"
BULLET = "CASE p_partkey % 3 WHEN 0 THEN p_size || '|' || p_name WHEN 1 THEN '|' || p_name ELSE p_name END"
_JOIN = "regexp_replace({}, '\\b([A-Za-z])\\s+([A-Za-z]{{3,}})\\b', '\\1\\2', 'g')"
_MB = "CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n / 1024.0 * 10 + 0.5) / 10) || ' KB' ELSE printf('%.2f', floor(n / 1048576.0 * 100 + 0.5) / 100) || ' MB' END"
_RUN = "regexp_extract_all(s, '(?:^|[^A-Za-z])((?:[A-Za-z] ){3,}[A-Za-z])(?:$|[^A-Za-z])', 1)"


@R.query(f"""SELECT p_partkey, {_MB} AS size, lower(regexp_replace(regexp_replace(regexp_replace(name, '[^0-9A-Za-z_\\s-]', '', 'g'), '^\\s+|\\s+$', '', 'g'), '\\s+', '-', 'g')) AS slug,
  CASE st {' '.join(f"WHEN {sql.q(k)} THEN {sql.q(v)}" for k, v in V.STATUS_ALIASES.items())} ELSE st END AS bucket, {_JOIN.format('s')} AS joined,
  list_reduce(list_prepend(s, list_distinct({_RUN})), lambda t, r: replace(t, r, replace(r, ' ', ''))) AS tight,
  CASE WHEN regexp_matches(b, '^[0-9]+[|].') THEN b[length(string_split(b, '|')[1]) + 2:] END AS id_text, least(p_brand, p_type) || chr(0) || greatest(p_brand, p_type) AS pair
  FROM (SELECT p_partkey, p_brand, p_type, {N} AS n, {NAME} AS name, {STATUS} AS st, {SPACED} AS s, {BULLET} AS b FROM part)""")
def text_labels(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "p_brand", "p_type", f"{N.replace('CAST(p_partkey * p_partkey * 37 % 5000000 AS BIGINT)', 'p_partkey * p_partkey * 37 % 5000000')} AS n", f"{NAME.replace(chr(39) * 2 + 'Neil', chr(92) + chr(39) + 'Neil')} AS name", f"{STATUS} AS st", f"{SPACED} AS s", f"{BULLET} AS b")
    c = F.col
    return p.select("p_partkey", L.shown_size(c("n")).alias("size"), L.slug(c("name")).alias("slug"), L.status_bucket(c("st")).alias("bucket"), L.joined_letter(c("s")).alias("joined"), L.tight_letters(c("s")).alias("tight"), L.id_text(c("b")).alias("id_text"), L.pair_key(c("p_brand"), c("p_type")).alias("pair"))


_PAY = "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_retailprice * 10 END AS low, CASE WHEN p_size % 4 > 0 THEN p_retailprice * CASE WHEN p_size % 5 = 0 THEN 10 ELSE 15 END END AS high, CASE p_size % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' WHEN 2 THEN 'EUR' ELSE 'CAD' END AS currency, CASE p_size % 3 WHEN 0 THEN 'hour' WHEN 1 THEN 'month' ELSE 'year' END AS period FROM part"


def _money(x: str) -> str:
    return f"CASE currency {' '.join(f'WHEN {sql.q(k)} THEN {sql.q(v)}' for k, v in V.CURRENCY_SIGNS.items())} ELSE currency || ' ' END || format('{{:,}}', CAST(floor({x} + 0.5) AS BIGINT))"


@R.query(f"SELECT p_partkey, CASE WHEN low <> high THEN {_money('low')} || '–' || {_money('high')} ELSE {_money('coalesce(high, low, 0)')} END || CASE period WHEN 'hour' THEN '/hr' WHEN 'month' THEN '/mo' ELSE '/yr' END AS pay FROM ({_PAY})")
def pay_labels(spark, sf):
    view = as_view(table(spark, sf, "part"))
    p = spark.sql(_PAY.replace("FROM part", f"FROM {view}"))
    return p.select("p_partkey", L.shown_pay(*map(F.col, ("low", "high", "currency", "period"))).alias("pay"))




def _count(x: str) -> str:
    """Edges are doubled, so that neighbouring words don't share one."""
    return f"CAST(len(regexp_extract_all(regexp_replace({x}, '([^0-9A-Za-z_])', '\\1\\1', 'g'), '(?:^|[^0-9A-Za-z_])the(?:$|[^0-9A-Za-z_])')) AS INTEGER)"


_BODY = "coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'What you bring' || chr(10) || text WHEN doc_id % 3 = 1 THEN chr(10) || 'Prerequirements' ELSE '' END"


@R.query(f"""SELECT doc_id, length(req) AS requirement_chars, {_count('lower(body)')} AS n_the, {_count('req')} AS n_the_required,
  CASE WHEN strpos(body, 'and') > 21 THEN '…' ELSE '' END || trim(regexp_replace(body[greatest(0, strpos(body, 'and') - 21) + 1:least(length(body), strpos(body, 'and') + 22)], '\\s+', ' ', 'g')) || CASE WHEN strpos(body, 'and') + 22 < length(body) THEN '…' ELSE '' END AS snippet
  FROM (SELECT *, CASE WHEN k > 0 THEN lower(array_to_string(lines[k:], chr(10))) ELSE '' END AS req FROM (SELECT *, coalesce(list_position(list_transform(lines, lambda l: {sql.has('l', V.REQUIREMENTS_HEADING)}), true), 0) AS k FROM (
  SELECT doc_id, body, string_split(body, chr(10)) AS lines FROM (SELECT doc_id, {_BODY} AS body FROM documents))))""")
def requirement_parts(spark, sf):
    """The requirements of each text, how often a word stands in all and in them, and the text around a word."""
    d = table(spark, sf, "documents").select("doc_id", F.expr(_BODY.replace("chr(10)", "char(10)")).alias("body"))
    body = F.col("body")
    d = d.withColumn("req", L.requirements_part(body))
    return d.select("doc_id", F.length("req").cast("bigint").alias("requirement_chars"), L.occurrences(F.lower(body), "the").alias("n_the"), L.occurrences(F.col("req"), "the").alias("n_the_required"), L.snippet(body, F.instr(body, "and") - 1, F.lit(3), 40).alias("snippet"))


def _markdown(x: str) -> str:
    for k in range(1, 7):
        x = sql.swap(x, f"(?is)<h{k}[^>]*>\\s*(.*?)\\s*</h{k}>", f"\n\n{'#' * k} \\1\n\n")
    for p, by in (("(?is)<(?:strong|b)(?:\\s[^>]*)?>(.*?)</(?:strong|b)>", "**\\1**"), ("(?is)<(?:em|i)(?:\\s[^>]*)?>(.*?)</(?:em|i)>", "*\\1*"), ("(?is)<li[^>]*>\\s*(.*?)\\s*</li>", "- \\1\n"), ("(?i)</?(?:ul|ol)[^>]*>", "\n"), ("(?i)<br\\s*/?>", "\n"), ("(?i)</p>", "\n\n"), ("(?i)</div>", "\n"), ("<[^>]+>", "")):
        x = sql.swap(x, p, by)
    for name, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        x = f"replace({x}, {sql.q(name)}, {sql.q(plain)})"
    return sql.swap(sql.swap(x, "\n{3,}", "\n\n"), "^\\s+|\\s+$")


@R.query(f"SELECT page_id, {_markdown('html')} AS markdown FROM pages")
def page_markdown(spark, sf):
    return table(spark, sf, "pages").select("page_id", L.html_markdown(F.col("html")).alias("markdown"))


_CAT = " || ".join
_POSTING = """'{"@type":"' || CASE WHEN p_size % 6 = 0 THEN 'Article' ELSE 'JobPosting' END || '","@context":"https://schema.org","title":" ' || p_name || ' ","hiringOrganization":{"name":"' || p_brand || '"},"datePosted":"2026-01-0' || (p_size % 9 + 1) || '"'
 || CASE p_size % 4 WHEN 0 THEN ',"jobLocation":{"address":{"addressLocality":"' || p_type || '","addressCountry":"DE"}}' WHEN 1 THEN ',"jobLocation":[{"address":{"addressLocality":"Rome","addressRegion":""}},{"name":"' || p_type || '"}]' WHEN 2 THEN ',"applicantLocationRequirements":{"name":"EU"}' ELSE ',"jobLocationType":"TELECOMMUTE"' END
 || CASE p_size % 5 WHEN 0 THEN ',"baseSalary":{"currency":"USD","value":{"minValue":' || (p_partkey * 1000 + 5) || ',"maxValue":' || (p_partkey * 2000 + 7) || ',"unitText":"YEAR"}}' WHEN 1 THEN ',"baseSalary":{"currency":"EUR","value":{"minValue":50000}}' WHEN 2 THEN ',"baseSalary":{"value":12000}' ELSE '' END
 || CASE p_size % 3 WHEN 0 THEN ',"identifier":"ID-' || p_partkey || '"' WHEN 1 THEN ',"identifier":{"name":"n","value":"V' || p_partkey || '"}' ELSE '' END || '}'"""
DOCUMENT = f"""CASE p_partkey % 5 WHEN 0 THEN {_POSTING} WHEN 1 THEN '{{"@context":"https://schema.org","@graph":[{{"@type":"WebPage"}},' || {_POSTING} || ']}}' WHEN 2 THEN '[{{"a":1}},' || {_POSTING} || ']' WHEN 3 THEN 'no json' ELSE {_POSTING} END"""


def _j(path: str, x: str = "p") -> str:
    return f"json_extract_string({x}, '{path}')"


_ARRAY = "CASE WHEN json_type(p, '$.jobLocation') = 'ARRAY' THEN json_extract(p, '$.jobLocation[*]') ELSE [json_extract(p, '$.jobLocation')] END"
_SHOWN = f"CASE WHEN json_extract(j, '$.address') IS NOT NULL THEN array_to_string(list_filter([{_j('$.address.addressLocality', 'j')}, {_j('$.address.addressRegion', 'j')}, {_j('$.address.addressCountry', 'j')}], lambda x: x <> ''), ', ') ELSE {_j('$.name', 'j')} END"
_NUM = "format('{{:,}}', CAST({} AS BIGINT))".format
_LOW, _HIGH, _CURRENCY = _j("$.baseSalary.value.minValue"), _j("$.baseSalary.value.maxValue"), f"coalesce({_j('$.baseSalary.currency')}, '')"


@R.query(f"""SELECT p_partkey, trim({_j('$.title')}) AS title, {_j('$.hiringOrganization.name')} AS company, nullif(array_to_string(list_filter(list_transform({_ARRAY}, lambda j: {_SHOWN}), lambda x: x <> ''), ' | '), '') AS location,
  CASE WHEN {_j('$.jobLocationType')} = 'TELECOMMUTE' OR (json_extract(p, '$.applicantLocationRequirements') IS NOT NULL AND json_extract(p, '$.jobLocation') IS NULL) THEN 'remote' END AS work_model,
  trim(CASE WHEN json_type(p, '$.baseSalary.value') IN ('UBIGINT', 'BIGINT') THEN {_CURRENCY} || ' ' || {_NUM(_j('$.baseSalary.value'))} WHEN {_LOW} IS NOT NULL AND {_HIGH} IS NOT NULL THEN {_CURRENCY} || ' ' || {_NUM(_LOW)} || ' - ' || {_NUM(_HIGH)} || ' per ' || lower({_j('$.baseSalary.value.unitText')})
    WHEN {_LOW} IS NOT NULL THEN {_CURRENCY} || ' ' || {_NUM(_LOW)} || '+' END) AS salary,
  coalesce({_j('$.identifier.value')}, {_j('$.identifier.name')}, CASE WHEN json_type(p, '$.identifier') = 'VARCHAR' THEN {_j('$.identifier')} END) AS job_id, {_j('$.datePosted')} AS posted
  FROM (SELECT p_partkey, list_filter(list_concat([d], list_concat(coalesce(json_extract(d, '$."@graph"[*]'), []), coalesce(json_extract(d, '$[*]'), []))), lambda c: json_extract_string(c, '$."@type"') = 'JobPosting')[1] AS p
  FROM (SELECT p_partkey, CAST(d AS JSON) AS d FROM (SELECT p_partkey, {DOCUMENT} AS d FROM part) WHERE json_valid(d))) WHERE p IS NOT NULL""")
def jsonld_postings(spark, sf):
    """Postings in JSON-LD: alone, in a graph, in an array."""
    p = table(spark, sf, "part").selectExpr("p_partkey", f"{DOCUMENT} AS d")
    return jsonld.postings(p, "p_partkey", "d").drop("content_hash")
