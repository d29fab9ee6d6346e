"""Queries over boards, captures, phrases, references in markdown and positioned items, made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgework.functions import labels as L
from sedgework.functions import values as V
from sedgework.operators import boards as N
from sedgework.operators import bullets as B
from sedgework.operators import layout as Y
from sedgework.operators import search as Q
from sedgework.plans import sql
from sedgework.plans.parse_queries import view
from sedgework.plans.registry import Registry
from sedgework.plans.shape_queries import _HAY, _ROLE_HIT, _SCORE, FAMILIES, LEVEL, NOISE, TITLES, _POSTING, posts
from sedgework.sources import feeds
from sedgework.sources.tables import dealt_out, table

R = Registry()
NOW = "1998-08-02 12:00:00"


@R.query(f"SELECT o_orderkey FROM orders WHERE epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate + to_seconds(CAST(o_orderkey * 3600 % 172800 AS INTEGER))) BETWEEN 0 AND {V.BOARD_TTL_HOURS * 3600 * 60}")
def cached_boards(spark, sf):
    """Orders stand for boards, sixty times as fresh as real ones have to be."""
    o = table(spark, sf, "orders").withColumn("then_", F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey * 3600 % 172800)"))
    gone = (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.col("then_").cast("timestamp"))) / 60
    now = F.lit(NOW).cast("timestamp")
    return N.cached(o.withColumn("updated_at", F.timestamp_seconds(F.unix_timestamp(now) - gone)), now).select("o_orderkey")


@R.query(f"SELECT l_suppkey, l_orderkey, l_linenumber, '' AS description FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_partkey) AS nth FROM lineitem) WHERE nth <= {V.CACHED_POSTINGS}")
def cache_rows(spark, sf):
    """Lines stand for postings, suppliers for boards."""
    from pyspark.sql import Window

    rows = table(spark, sf, "lineitem").withColumn("ord", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_partkey"))).withColumn("description", F.col("l_returnflag"))
    return N.to_cache(rows, "l_suppkey", "ord", F.lit(NOW)).select("l_suppkey", "l_orderkey", "l_linenumber", "description")


@R.query(f"""SELECT id, score, nth, CASE WHEN p_partkey % 3 = 0 THEN 'text of ' || id ELSE '' END AS description FROM (SELECT *, CAST(row_number() OVER (PARTITION BY company ORDER BY score DESC, p_partkey) AS INTEGER) AS nth FROM (
  SELECT *, {_SCORE} AS score, NOT contains({_HAY}, 'cold') AS kept, bool_or(NOT contains({_HAY}, 'cold')) OVER (PARTITION BY company) AS any_kept FROM ({_POSTING}) WHERE {_ROLE_HIT}) WHERE kept OR NOT any_kept) WHERE nth <= 3""")
def board_results(spark, sf):
    """Role filter, excluded words, order, cap and late descriptions of each board."""
    p = posts(spark, sf).withColumn("description", F.lit(""))
    score = Q.title_score(F.col("title"), F.col("departments"), TITLES, LEVEL, NOISE)
    left = N.board_search(p, FAMILIES, ["cold"], score, "company", "p_partkey", 3)
    texts = p.where("p_partkey % 3 = 0").select("id", F.concat(F.lit("text of "), "id").alias("text"))
    return N.hydrated(left, texts).select("id", "score", "nth", "description")


_URL = "'https://www.jobs.example.com/' || {} || '?utm_source=x'"
_CAPTURES = f"SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'own-' || o_orderkey ELSE '' END AS id, o_orderpriority AS title, {_URL.format('o_orderkey')} AS url, 'new' AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'note' END AS notes, array(concat('http://jobs.example.com/', o_custkey), {_URL.format('o_orderkey')}) AS alias_urls FROM orders "
_OLD = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'own-' || o_orderkey ELSE 'job:jobs.example.com/' || o_orderkey END AS id, 'old' AS title, 'https://old.example.com/' || o_orderkey AS url, o_orderstatus AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'mine' END AS notes, array('https://other.example.com/1', concat('https://jobs.example.com/', o_custkey)) AS alias_urls FROM orders WHERE o_orderkey % 4 = 0"


@R.query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'own-' || o_orderkey ELSE 'job:jobs.example.com/' || o_orderkey END AS id, o_orderpriority AS title, 'https://www.jobs.example.com/' || o_orderkey || '?utm_source=x' AS url, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE 'new' END AS status,
  CASE WHEN o_orderkey % 20 = 0 THEN 'mine' WHEN o_orderkey % 2 = 0 THEN 'note' END AS notes,
  CASE WHEN o_orderkey % 4 = 0 THEN 'https://other.example.com/1' || CASE WHEN o_custkey <> o_orderkey THEN ',https://jobs.example.com/' || o_custkey ELSE '' END || ',http://jobs.example.com/' || o_custkey
    ELSE 'http://jobs.example.com/' || o_custkey || ',https://www.jobs.example.com/' || o_orderkey || '?utm_source=x' END AS aliases, o_orderkey % 4 <> 0 AS created FROM orders""")
def captured_jobs(spark, sf):
    """Inputs merged into jobs: status and notes of an old job stay, other URLs are united."""
    jobs, new = view(spark, sf, _OLD, "orders"), view(spark, sf, _CAPTURES, "orders")
    return N.captured(jobs, new).select("id", "title", "url", "status", "notes", F.array_join("alias_urls", ",").alias("aliases"), "created")


_LINK = "CASE p_partkey % 7 WHEN 0 THEN 'https://www.linkedin.com/jobs/' WHEN 1 THEN 'uk.indeed.com/view?x=1' WHEN 2 THEN 'https://www.glassdoor.co.uk/j' WHEN 3 THEN 'https://acme.wd1.myworkdayjobs.com/x' WHEN 4 THEN 'https://angel.co/c' WHEN 5 THEN 'https://notlinkedin.com/' ELSE p_name END"
_LINES = "CASE p_partkey % 4 WHEN 0 THEN concat(char(10), '  ', p_name, char(10), 'more') WHEN 1 THEN repeat(p_name, 20) WHEN 2 THEN '' ELSE concat(p_brand, ' ', p_type, char(10)) END"
_TITLES = "CASE WHEN p_size % 2 = 0 THEN array(concat(' ', p_name)) ELSE array() END"
_CASES = " ".join(f"WHEN {sql.has('h', p)} THEN {sql.q(n)}" for n, p in V.CLOSED_HOSTS)


@R.query(f"""SELECT p_partkey, CASE {_CASES} END AS closed, CASE WHEN f IS NULL OR length(f) > {V.DERIVED_TITLE_CHARS} THEN 'Untitled job' ELSE f END AS title, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'a b c' END AS phrase, CASE WHEN p_size % 3 > 0 THEN 'a' WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS keyword FROM (
  SELECT *, regexp_replace(regexp_replace({_LINK}, '(?i)^[a-z]+://', ''), '[/?#:].*$', '') AS h, list_filter(list_transform(string_split({_LINES.replace('char(10)', 'chr(10)')}, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS f FROM part)""")
def search_inputs(spark, sf):
    """Hosts that can't be read, titles of texts, and what a query is searched by."""
    p = view(spark, sf, f"SELECT p_partkey, p_size, {_LINK} AS u, {_LINES} AS t, {_TITLES} AS titles FROM part ", "part").withColumn("titles", F.col("titles").cast("array<string>"))
    skills = F.array(*map(F.lit, "abcd"))
    some = F.when(F.col("p_size") % 3 > 0, skills).otherwise(F.array().cast("array<string>"))
    return p.select("p_partkey", N.closed_host(F.col("u")).alias("closed"), N.derived_title(F.col("t")).alias("title"), N.search_phrase(F.col("titles"), skills).alias("phrase"), N.primary_keyword(F.col("titles"), some).alias("keyword"))


_BARE = "trim(bullet)"
for _p in ("^[0-9]+[.)]\\s*", "^[•*-]\\s*", "^[*]+", "^[\"'`“‘]"):
    _BARE = f"regexp_replace({_BARE}, {sql.q(_p)}, '')"
_STOPS = ", ".join(map(sql.q, V.PHRASE_STOPS))
_MARKED = f"array_to_string(list_filter(list_transform(w[2:], lambda t: CASE WHEN t IN ({_STOPS}) THEN '|' WHEN regexp_matches(t, '^[$]?[0-9]') OR length(regexp_replace(t, '[^a-z''-]', '', 'g')) < 3 THEN '' ELSE regexp_replace(t, '[^a-z''-]', '', 'g') END), lambda t: t <> ''), ' ')"


@R.query(f"""SELECT doc_id, string_agg(p, '; ' ORDER BY last, p) AS phrases FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY last DESC) AS nth FROM (SELECT doc_id, p, max(ord) AS last FROM (
  SELECT doc_id, ord, CASE WHEN len(w) >= 3 THEN nullif(regexp_extract({_MARKED}, '([a-z''-]+ [a-z''-]+)', 1), '') END AS p FROM (SELECT doc_id, ord, string_split_regex(lower({_BARE}), '\\s+') AS w FROM ({sql.bullets()}))) WHERE p IS NOT NULL GROUP BY doc_id, p)) WHERE nth <= {V.PHRASE_BRIEF} GROUP BY doc_id""")
def phrase_briefs(spark, sf):
    """The last eight phrases of each document's lines."""
    return N.phrase_brief(B.bullets(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "ord", "bullet")


_JSON = {
    "greenhouse": "'{\"id\": ' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE p_partkey || '' END || ', \"title\": \" ' || CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END || '\", \"absolute_url\": \"https://b.example/' || p_partkey || '\", \"location\": {\"name\": \"' || p_type || '\"}, \"departments\": [{\"name\": \"' || p_type || '\"}, {}], \"updated_at\": \"2026\"}'",
    "ashby": "'{\"id\": \"x' || p_partkey || '\", \"title\": \"' || p_name || '\", \"jobUrl\": \"' || CASE WHEN p_size % 7 = 0 THEN '' ELSE 'https://a.example/' || p_partkey END || '\", \"department\": \"' || p_type || '\", \"descriptionHtml\": \"<p>' || p_name || ' &amp; co</p>\"' || CASE WHEN p_size % 2 = 0 THEN ', \"descriptionPlain\": \"plain\"' ELSE '' END || '}'",
}


@R.query("""SELECT 'greenhouse:' || lower(p_brand) || ':' || CASE WHEN p_size % 5 = 0 THEN 'https://b.example/' || p_partkey ELSE p_partkey || '' END AS id, p_name AS title, p_type AS location, 'https://b.example/' || p_partkey AS url, '' AS description, '2026' AS posted_at, p_type AS departments FROM part WHERE p_size % 7 > 0
  UNION ALL SELECT 'ashby:' || lower(p_brand) || ':x' || p_partkey, p_name, '', 'https://a.example/' || p_partkey, CASE WHEN p_size % 2 = 0 THEN 'plain' ELSE p_name || ' & co' END, NULL, p_type FROM part WHERE p_size % 7 > 0""")
def board_feeds(spark, sf):
    """Postings of two kinds of company boards."""
    rows = [feeds.board_postings(view(spark, sf, f"SELECT lower(p_brand) AS slug, p_brand AS company, {j} AS json FROM part ", "part"), f) for f, j in _JSON.items()]
    return feeds.union(rows).select("id", "title", "location", "url", "description", "posted_at", F.array_join("departments", ",").alias("departments"))


MARKDOWN = "concat('See [', p_name, '][Ref ', p_size % 3, '], [ref  1] and [none][x]. ![pic][ref 2] ![keep][no] [][ref 1]', char(10), '[ref 1]: https://one.example/', p_partkey, char(10), '[REF 1]: https://two.example', char(10), '  [ref 2]: <www.three.example> \"t\"', char(10), '[bad]: nowhere')"


@R.query("""SELECT p_partkey, 'See ' || CASE p_size % 3 WHEN 1 THEN p_name || ' https://one.example/' || p_partkey WHEN 2 THEN p_name || ' www.three.example' ELSE '[' || p_name || '][Ref 0]' END || ', ref  1 https://one.example/' || p_partkey || ' and [none][x].  ![keep][no] https://one.example/' || p_partkey || repeat(chr(10), 4) || '[bad]: nowhere' AS resolved FROM part""")
def reference_links(spark, sf):
    """Reference links of markdown as text and address; their definitions and images go."""
    parts = dealt_out(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    return parts.select("p_partkey", F.expr(MARKDOWN).alias("md")).select("p_partkey", feeds.resolved_links(F.col("md")).alias("resolved"))


_ITEMS = "SELECT l_orderkey AS doc, CAST(l_linenumber % 2 AS INT) AS page, CAST(floor(l_linenumber / 3) AS INT) AS row, CAST(l_partkey % 50 * 10 AS DOUBLE) AS x, CAST(floor(l_linenumber / 3) * 12 + l_linenumber % 2 AS DOUBLE) AS y, CAST(5 + l_suppkey AS DOUBLE) AS width, CAST(l_quantity AS DOUBLE) AS font, CASE l_linenumber % 4 WHEN 0 THEN concat(l_linestatus, ' ', l_shipdate) WHEN 1 THEN concat(l_returnflag, l_partkey, ' ') ELSE concat('w', l_partkey) END AS str FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus, l_returnflag, '1' AS l_shipdate FROM lineitem ) "
_ROWS = f"""SELECT doc, page, row, min(y) AS y, max(font) AS font, trim(regexp_replace(string_agg(CASE WHEN last IS NOT NULL AND NOT regexp_matches(last, '\\s$') AND NOT regexp_matches(str, '^\\s') AND x - e > lw / greatest(length(last), 1) * CAST({V.SPACE_SHARE} AS DOUBLE) THEN ' ' ELSE '' END || str, '' ORDER BY x, str, width), '\\s+', ' ', 'g')) AS text
  FROM (SELECT *, lag(str) OVER w AS last, lag(x + width) OVER w AS e, lag(width) OVER w AS lw FROM ({_ITEMS}) WINDOW w AS (PARTITION BY doc, page, row ORDER BY x, str, width)) GROUP BY doc, page, row"""


def item_rows(spark, sf):
    return Y.row_texts(view(spark, sf, _ITEMS, "lineitem"), ["doc", "page", "row"])


@R.query(_ROWS)
def item_lines(spark, sf):
    """Positioned items as lines: blanks where gaps are wide."""
    return item_rows(spark, sf)


@R.query(f"SELECT doc, string_agg(CASE WHEN before <> page THEN chr(10) ELSE '' END || text, chr(10) ORDER BY page, row) AS text FROM (SELECT *, lag(page) OVER (PARTITION BY doc ORDER BY page, row) AS before FROM ({_ROWS})) GROUP BY doc")
def item_texts(spark, sf):
    return Y.document_text(item_rows(spark, sf), "doc")


@R.query(f"SELECT doc, page, coalesce(median(s) FILTER (s > 0), 0) AS height FROM (SELECT *, y - lag(y) OVER (PARTITION BY doc, page ORDER BY row) AS s FROM ({_ROWS})) GROUP BY doc, page")
def line_heights(spark, sf):
    return Y.line_height(item_rows(spark, sf), ["doc", "page"], ["row"])


@R.query(f"SELECT doc, page, x, str, CAST(page = 1 AND x >= 200 AS INTEGER) AS band FROM ({_ITEMS})")
def column_bands(spark, sf):
    items = view(spark, sf, _ITEMS, "lineitem").withColumn("split", F.when(F.col("page") == 1, 200.0))
    return Y.column_order(items, ["doc", "page"]).select("doc", "page", "x", "str", "band")


@R.query("SELECT p_partkey FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part GROUP BY p_brand HAVING max(CASE WHEN p_size % 50 = 0 THEN 2 ELSE 1 END) <= 1 AND bool_or(p_size % 5 = 0))")
def icon_fonts(spark, sf):
    """Parts stand for items, brands for fonts."""
    s = F.when(F.col("p_size") % 50 == 0, "ab").when(F.col("p_size") % 5 == 0, "\ue010").otherwise(" a ")
    return Y.without_icons(table(spark, sf, "part").select("p_partkey", F.lit(1).alias("doc"), F.col("p_brand").alias("font_name"), s.alias("str")), ["doc"]).select("p_partkey")
