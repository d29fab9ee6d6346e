"""Queries over shapes of lines and links, over search, and over contact cards: parts are the postings, customers the records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.functions import shapes as H
from sedgework.functions import text as X
from sedgework.functions import values as V
from sedgework.operators import bullets as B
from sedgework.operators import checks as K
from sedgework.operators import search as Q
from sedgework.plans import sql
from sedgework.plans.registry import Registry
from sedgework.sources.tables import as_view, table

R = Registry()

#: A line of each part, of one of fifteen shapes.
LINE = """CASE p_partkey % 15 WHEN 0 THEN p_name || ' engineer' WHEN 1 THEN upper(p_name) || ' SUMMARY' WHEN 2 THEN p_brand || ' Holdings' WHEN 3 THEN 'Riverside University of ' || p_type
 WHEN 4 THEN 'School Counselor, ' || p_name WHEN 5 THEN 'IC4 · ' || p_type || ' · ' || p_size WHEN 6 THEN 'Founding ' || p_name || ' leader; owned charter' WHEN 7 THEN 'Led ' || p_name || ' platform Across Teams'
 WHEN 8 THEN 'Sold to ' || p_type || ' Inc.' WHEN 9 THEN 'Jane Doe · Résumé ' || p_size WHEN 10 THEN 'Jane Doe CV ' || p_size WHEN 11 THEN 'Cardiovascular (CV) Fellowship' WHEN 12 THEN 'jane' || p_partkey || '@example.com | (312) 555-0123'
 WHEN 13 THEN 'see linkedin.com/in/u' || p_partkey ELSE 'We made the ' || p_name || ' better for all. The team then shipped it' END"""
_LINES = f"SELECT p_partkey, p_size, {LINE} AS line FROM part"


def _word(s: str, words: str) -> str:
    return sql.has(s, f"(?i)(^|[^0-9A-Za-z_])(?:{words})($|[^0-9A-Za-z_])")


def _title(s: str) -> str:
    return f"(NOT {_word(s, V.COMPANY_WORDS)} AND {_word(s, V.TITLE_WORDS)})"


def _middot(s: str) -> str:
    parts = f"list_filter(string_split_regex(trim({s}), '\\s*·\\s*'), lambda p: p <> '')"
    return f"(len({parts}) >= 2 AND coalesce({sql.has(parts + '[1]', V.GRADE_CODE)}, false))"


def _scope(s: str) -> str:
    bare = f"list_transform(string_split_regex(trim({s}), '\\s+')[2:], lambda w: regexp_replace(w, '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g'))"
    lower = sql.has("w", "^\\p{Ll}[\\p{Ll}\\p{M}'’-]*$")
    return f"({sql.verb(s)} AND coalesce(list_bool_or(list_transform({bare}, lambda w: {lower} AND w NOT IN ({', '.join(map(sql.q, V.CONNECTORS))}))), false))"


def _below(s: str) -> str:
    return f"(trim({s}) <> '' AND (contains({s}, ';') OR {_middot(s)} OR {_scope(s)} OR ({sql.has(f'trim({s})', '[.!?]$')} AND NOT {sql.has(f'trim({s})', V.LEGAL_END)})))"


def _form(s: str) -> str:
    return f"length(trim({s})) BETWEEN 1 AND {V.HEADER_CHARS} AND NOT {sql.has(f'trim({s})', V.HEADER_BULLET)} AND NOT {sql.has(f'trim({s})', '[.!?]$')}"


def _capital(s: str) -> str:
    letters = sql.swap(s, "[^A-Za-z]")
    return f"({_form(s)} AND NOT {sql.has(s, V.HEADER_DIRT)} AND {letters} <> '' AND {letters} = upper({letters}) AND len({sql.tokens(f'trim({s})')}) BETWEEN 2 AND {V.CAPITAL_WORDS})"


def _contact(s: str) -> str:
    return f"({sql.has(s, V.EMAIL)} OR {sql.has(s, V.PHONE + '($|[^0-9A-Za-z_])')} OR {sql.has(s, V.LINKEDIN_PROFILE)})"


@R.query(f"""SELECT p_partkey, {_title('line')} AS title, ({_word('line', V.COMPANY_WORDS)} OR {_word('line', V.SCHOOL_WORDS)}) AND NOT {_title('line')} AS company,
  {_middot('line')} AS grade_line, {_scope('line')} AS verb_scope, {_below('line')} AS scope_prose, {sql.has('line', V.FURNITURE)} OR {sql.has('line', V.LONE_CV)} AS furniture, {_capital('line')} AS capital_header,
  ({_form('line')} AND len({sql.tokens('trim(line)')}) <= {V.HEADER_WORDS} AND p_size >= 25 * {V.HEADER_FONT}) OR {_capital('line')} AS visual_header, {_contact('line')} AS contact FROM ({_LINES})""")
def line_shapes(spark, sf):
    """What each line looks like; a part's size stands for its font."""
    line = F.col("line")
    return table(spark, sf, "part").selectExpr("p_partkey", "p_size", f"{LINE} AS line").select(
        "p_partkey", H.looks_like_title(line).alias("title"), H.looks_like_company(line).alias("company"), H.is_middot_metadata(line).alias("grade_line"), H.is_verb_led_scope(line).alias("verb_scope"),
        H.is_scope_prose(line).alias("scope_prose"), H.is_page_furniture(line).alias("furniture"), H.is_capital_header(line).alias("capital_header"),
        H.is_visual_header(line, F.col("p_size"), F.lit(25)).alias("visual_header"), H.has_contact(line).alias("contact"),
    )


URL = """CASE s_suppkey % 8 WHEN 0 THEN 'https://www.linkedin.com/in/u' || s_suppkey || '/' WHEN 1 THEN 'linkedin.com/company/x' || s_suppkey WHEN 2 THEN 'node.js' WHEN 3 THEN 'jane.dev/p/' || s_suppkey
 WHEN 4 THEN 'www.u' || s_suppkey || '.zzz,' WHEN 5 THEN 'https://' WHEN 6 THEN 'ftp://files.example.com/' || s_suppkey ELSE ' ' END"""
_SCHEME = "(?i)^(https?://|www[.])"
_FULL = "regexp_replace(regexp_replace(trim(u), '[,;.)/]+$', ''), '(?i)^(https?://)?www[.]', '\\1')"


@R.query(f"""SELECT s_suppkey, {sql.has('u', '(?i)linkedin[.]com/[A-Za-z0-9]')} AND NOT {sql.has('u', V.LINKEDIN_OTHER)} AS profile, {sql.has('u', _SCHEME)} OR string_split(string_split(lower(u), '/')[1], '.')[-1] IN ({', '.join(map(sql.q, V.WEBSITE_TLDS))}) AS website,
  {sql.has('u', _SCHEME)} OR s_suppkey % 3 <> 0 OR NOT ({sql.has('u', '[0-9A-Za-z_/,.]$')} AND s_suppkey % 2 = 0) AS standalone,
  CASE WHEN {_FULL} <> '' AND NOT regexp_matches({_FULL}, '(?i)^[a-z][a-z0-9+.-]*:$') THEN CASE WHEN regexp_matches({_FULL}, '(?i)^[a-z][a-z0-9+.-]*://') THEN {_FULL} ELSE 'https://' || {_FULL} END END AS full_url,
  regexp_replace(regexp_replace(regexp_replace(trim(u), '(?i)^https?://', ''), '(?i)^www[.]', ''), '/+$', '') AS shown FROM (SELECT s_suppkey, {URL} AS u FROM supplier)""")
def link_shapes(spark, sf):
    """Profiles, websites, links inside of sentences, and links as they are stored and shown."""
    u = F.col("u")
    inside = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("sold "), u, F.when(F.col("s_suppkey") % 2 == 0, F.lit(" to many")).otherwise(F.lit(" | many")))).otherwise(u)
    return table(spark, sf, "supplier").selectExpr("s_suppkey", f"{URL} AS u").select(
        "s_suppkey", H.is_linkedin_profile(u).alias("profile"), H.is_website(u).alias("website"), H.is_standalone_url(u, inside).alias("standalone"), H.full_url(u).alias("full_url"), H.shown_url(u).alias("shown"),
    )


TOKEN = "CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN 'R' WHEN 2 THEN 'x' WHEN 3 THEN p_size || '' WHEN 4 THEN '2001 - 2005' WHEN 5 THEN 'GitHub' WHEN 6 THEN 'one two three four five six ' || p_name ELSE p_type || ' & ' || p_brand END"


@R.query(f"""SELECT p_partkey, lower(t) IN ('c', 'r', 'd') OR (length(t) BETWEEN 2 AND 40 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT regexp_matches(t, '(?i)(linkedin|github)') AND NOT {sql.has('t', V.SKILL_RANGE)} AND len(string_split_regex(t, '\\s+')) <= 6) AS skill
  FROM (SELECT p_partkey, {TOKEN} AS t FROM part)""")
def skill_tokens(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", f"{TOKEN} AS t").select("p_partkey", H.is_skill_token(F.col("t")).alias("skill"))


# entries and the lines that they own

_TITLE = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' [2019]' WHEN 1 THEN p_name || ', ' || (1990 + p_size % 30) WHEN 2 THEN '' ELSE p_name END"
_OWNED = "CASE p_partkey % 3 WHEN 0 THEN '• Award · ' || p_name WHEN 1 THEN '- ' || p_name || ' · 2021' ELSE p_name || ' plus' END"


def _title_key(s: str) -> str:
    out = sql.key(s)
    for p in ("\\s*\\[[^\\]]*\\]\\s*$", "[\\s,;·|–—-]*((19|20)[0-9]{2})\\s*$", "[\\s,;·|–—-]+$"):
        out = sql.swap(out, p)
    return f"trim({out})"


@R.query(f"""SELECT p_partkey, owned, key, owned <> '' AND (key = owned OR coalesce(CASE WHEN contains(key, ' · ') AND length(string_split(key, ' · ')[1]) BETWEEN 1 AND {V.ACHIEVEMENT_TYPE_CHARS} THEN key[length(string_split(key, ' · ')[1]) + 4:] = owned END, false)) AS owns
  FROM (SELECT p_partkey, {_title_key('title')} AS owned, {_title_key('line')} AS key FROM (SELECT p_partkey, {_TITLE} AS title, {_OWNED} AS line FROM part))""")
def title_owned_lines(spark, sf):
    """Whether an entry's title owns a line; keys of both."""
    p = table(spark, sf, "part").selectExpr("p_partkey", f"{_TITLE} AS title", f"{_OWNED} AS line")
    return p.select("p_partkey", H.title_key(F.col("title")).alias("owned"), H.title_key(F.col("line")).alias("key"), H.owned_by_title(F.col("line"), F.col("title")).alias("owns"))


@R.query(f"""WITH e AS (SELECT DISTINCT {_title_key('title')} AS key FROM (SELECT {_TITLE} AS title FROM part WHERE p_partkey % 2 = 0)), b AS (SELECT p_partkey, {_OWNED} AS line, {_title_key(_OWNED)} AS key FROM part)
  SELECT p_partkey, line FROM b WHERE key NOT IN (SELECT key FROM e WHERE key <> '') AND coalesce(CASE WHEN contains(key, ' · ') THEN key[length(string_split(key, ' · ')[1]) + 4:] END, '-') NOT IN (SELECT key FROM e)""")
def lines_without_owned(spark, sf):
    """Lines that no title of an entry owns: two anti joins on keys."""
    p = table(spark, sf, "part").selectExpr("p_partkey", f"{_TITLE} AS title", f"{_OWNED} AS line")
    return K.without_owned_lines(p, p.where("p_partkey % 2 = 0"), "line", "title").select("p_partkey", "line")


_ROLE = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 <> 0 THEN p_name END AS title, CASE WHEN o_orderkey % 3 <> 0 THEN p_brand END AS company, p_type AS place, CASE WHEN o_orderkey % 2 = 0 THEN p_size || '' END AS team, CASE WHEN o_orderkey % 5 <> 0 THEN '2019' END AS start, CASE WHEN o_orderkey % 7 <> 0 THEN '2023' END AS last, o_orderkey % 6 = 0 AS current FROM orders JOIN part ON o_orderkey % 200 = p_partkey"


def roles(spark: SparkSession, sf: str) -> DataFrame:
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    view = as_view(o.join(p, F.col("o_orderkey") % 200 == F.col("p_partkey")))
    return spark.sql(_ROLE.replace("orders JOIN part ON o_orderkey % 200 = p_partkey", view))


@R.query(f"""SELECT o_orderkey, CASE WHEN title IS NULL AND company IS NULL THEN 'Untitled role' ELSE concat_ws(' — ', title, company) END AS label,
  concat_ws(' · ', CASE WHEN title IS NOT NULL OR company IS NOT NULL THEN concat_ws(' — ', title, company) END, nullif(concat_ws('–', start, CASE WHEN current THEN 'Present' ELSE last END), '')) AS header FROM ({_ROLE})""")
def role_headers(spark, sf):
    r = roles(spark, sf)
    return r.select("o_orderkey", H.role_label(F.col("title"), F.col("company")).alias("label"), H.role_header(*map(F.col, ("title", "company", "start", "last", "current"))).alias("header"))


_HEADLINE = "CASE o_orderkey % 4 WHEN 0 THEN company || ' / ' || title WHEN 1 THEN title || ', ' || company || ' @ ' || place WHEN 2 THEN company || ' | ' || title || ' (' || place || ') ' || team ELSE title || ' ' || company || ' again' END"
_TAILS = ("NULL", "place", "team", "concat_ws(' ', place, team)")
_KEYS = " UNION ".join(f"SELECT o_custkey, {sql.flat(f'concat_ws({sql.q(chr(32))}, {a}, {b}, {t})')} AS key FROM r WHERE title IS NOT NULL AND company IS NOT NULL" for t in _TAILS for a, b in (("title", "company"), ("company", "title")))


@R.query(f"""WITH r AS ({_ROLE}), k AS ({_KEYS}), b AS (SELECT o_orderkey, o_custkey, {_HEADLINE} AS line FROM r)
  SELECT o_orderkey, line FROM b WHERE line IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.o_custkey = b.o_custkey AND k.key = {sql.flat('line')})""")
def lines_without_headers(spark, sf):
    """A customer's lines but for those that only say a role's head again: an anti join on its keys."""
    r = roles(spark, sf)
    lines = r.selectExpr("o_orderkey", "o_custkey", f"{_HEADLINE} AS line").where("line IS NOT NULL")
    return K.without_header_lines(lines, r, "o_custkey", "line").select("o_orderkey", "line")


@R.query(f"SELECT doc_id, CAST(ord AS INTEGER) AS ord, NOT (has_metric AND verb_led AND words BETWEEN 8 AND 30) AS needs_attention FROM ({sql.features()})")
def attention_lines(spark, sf):
    f = B.features(B.bullets(table(spark, sf, "documents").select("doc_id", "text")))
    return f.select("doc_id", "ord", K.needs_attention(F.col("has_metric"), F.col("verb_led"), F.col("words")).alias("needs_attention"))


# search

TITLES, SKILLS, NOISE = ["Senior red widget", "large bolt of the north"], ["steel", "c++", "the", "go"], ("north",)
FAMILIES, EXCLUDED, COMPANIES, LEVEL = ["widget", "promo"], ["cold"], ["brand13", "brand5"], "Senior"
_POSTING = "SELECT p_partkey, lower(replace(p_brand, '#', '')) || ':' || p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'Senior ' || p_name WHEN 1 THEN 'Jr ' || p_name WHEN 2 THEN p_name || ' lead' ELSE p_name END AS title, p_brand AS company, p_type AS department, p_type || CASE p_size % 4 WHEN 0 THEN ' of c++, steels' WHEN 1 THEN ' steel' ELSE ' steels' END AS description FROM part"


def posts(spark: SparkSession, sf: str) -> DataFrame:
    view = as_view(table(spark, sf, "part"))
    return spark.sql(_POSTING.replace("FROM part", f"FROM {view}")).withColumn("departments", F.array("department"))


def _literals(items) -> str:
    return "[" + ", ".join(map(sql.q, items)) + "]"


_STOP = ", ".join(map(sql.q, V.QUERY_STOPWORDS))
_TERMS = f"""list_concat(list_filter(flatten(list_transform({_literals(TITLES)}, lambda x: {sql.title_tokens('x')})), lambda t: length(t) >= 3 AND t NOT IN ({_STOP}) AND t NOT IN ({', '.join(map(sql.q, NOISE))})),
  list_filter({_literals(SKILLS)}, lambda t: t NOT IN ({_STOP}) AND (length(t) >= 3 OR regexp_matches(t, '[^a-z0-9]'))))"""


@R.query(f"""SELECT id, title FROM (SELECT *, lower(title || chr(10) || description) AS low FROM ({_POSTING})), (SELECT {_TERMS} AS terms)
  WHERE list_bool_or(list_transform(terms, lambda t: regexp_matches(low, '(^|[^a-z0-9])' || regexp_escape(t) || '($|[^a-z0-9])')))""")
def query_matches(spark, sf):
    return posts(spark, sf).where(Q.matches_query(F.col("title"), F.col("description"), Q.query_terms(TITLES, SKILLS, NOISE))).select("id", "title")


_HAY = "lower(title || ' ' || department)"
_ROLE_HIT = "(" + " OR ".join(f"contains({_HAY}, {sql.q(k)})" for k in FAMILIES) + ")"


@R.query(f"""WITH p AS ({_POSTING}), r AS (SELECT *, false AS role_suppressed FROM p WHERE {_ROLE_HIT} UNION ALL SELECT *, true FROM p WHERE NOT EXISTS (SELECT 1 FROM p WHERE {_ROLE_HIT})),
  x AS (SELECT * FROM r WHERE NOT contains({_HAY}, 'cold')) SELECT id, role_suppressed, false AS suppressed FROM x UNION ALL SELECT id, role_suppressed, true FROM r WHERE NOT EXISTS (SELECT 1 FROM x)""")
def refined_postings(spark, sf):
    """Role filter and excluded words, each fail-open."""
    return Q.refine(posts(spark, sf), FAMILIES, EXCLUDED).select("id", "role_suppressed", "suppressed")


@R.query(f"SELECT id FROM ({_POSTING}) WHERE {_ROLE_HIT}")
def role_filter(spark, sf):
    return posts(spark, sf).where(Q.role_hit(F.col("title"), F.col("departments"), FAMILIES)).select("id")


@R.query(f"SELECT id FROM ({_POSTING}) WHERE NOT starts_with(id, 'brand13:') AND NOT starts_with(id, 'brand5:')")
def without_companies(spark, sf):
    return Q.drop_companies(posts(spark, sf), COMPANIES).select("id")


def _words(s: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({s}), '[\\s/,&()-]+'), lambda w: length(w) >= {V.LEAST_WORD}))"


_WANTED = f"list_filter(list_distinct(flatten(list_transform({_literals(TITLES)}, lambda x: {_words('x')}))), lambda w: w NOT IN ({', '.join(map(sql.q, NOISE))}))"
_SCORE = f"CAST(len(list_intersect({_words(_HAY)}, {_WANTED})) * {V.TITLE_WORD_POINTS} + coalesce(greatest(0, {V.LEVEL_POINTS} - abs({sql.rung(sql.seniority('title'))} - {V.SENIORITY_RUNGS[LEVEL]})), 0) AS BIGINT)"


@R.query(f"SELECT id, score, CAST(row_number() OVER (PARTITION BY company ORDER BY score DESC, p_partkey) AS INTEGER) AS nth FROM (SELECT *, {_SCORE} AS score FROM ({_POSTING}))")
def title_order(spark, sf):
    """Each posting's score against the wanted titles, and its place within its company."""
    score = Q.title_score(F.col("title"), F.col("departments"), TITLES, LEVEL, NOISE)
    return Q.ordered_by_title(posts(spark, sf), score, "company", "p_partkey").select("id", "score", "nth")


def _band(x: str, bands: tuple, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {least} THEN {sql.q(phrase)}" for least, phrase in bands) + f" ELSE {other} END"


_STARS = "SELECT p_partkey, p_size / 10.0 AS fit, CASE WHEN p_size % 3 > 0 THEN 2 + p_size % 7 / 2.0 END AS pay, CASE WHEN p_size % 4 > 0 THEN CAST(p_size % 6 AS DOUBLE) END AS place, CASE WHEN p_size % 5 > 0 THEN p_size % 11 / 2.0 END AS level, p_size % 2 = 0 AS floor FROM part"


@R.query(f"""SELECT p_partkey, p_partkey % 40 / (p_partkey % 40 + {V.TERMS_HALF}) AS trust, concat_ws('|', {_band('fit', V.FIT_BANDS, "'Weak fit'")}, CASE WHEN floor THEN {_band('pay', V.FLOOR_BANDS)} ELSE {_band('pay', V.PAY_BANDS)} END,
  CASE WHEN place >= 5 THEN 'Location match' END, CASE WHEN level >= {V.LEVEL_MATCH} THEN 'Level match' WHEN level < {V.LEVEL_GAP} THEN 'Level gap' END) AS phrases FROM ({_STARS})""")
def rating_words(spark, sf):
    view = as_view(table(spark, sf, "part"))
    s = spark.sql(_STARS.replace("FROM part", f"FROM {view}").replace("10.0", "10D").replace("2.0", "2D"))
    return s.select("p_partkey", Q.specificity(F.col("p_partkey") % 40).alias("trust"), F.array_join(Q.rating_phrases(*map(F.col, ("fit", "pay", "place", "level", "floor"))), "|").alias("phrases"))


def _role_tokens(s: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({s}), '[^a-z0-9+#]+'), lambda t: length(t) >= 2 AND t NOT IN ({', '.join(map(sql.q, V.LEVEL_WORDS))})))"


_TARGET = "Senior widgets and bolted rings, reds"
_PREFIX = "list_max(list_filter(generate_series(0, least(length(t), length(w))), lambda k: t[1:k] = w[1:k]))"


@R.query(f"""SELECT p_partkey, CAST(coalesce(sum(CASE WHEN exact THEN 2 WHEN loose THEN 1 ELSE 0 END), 0) AS INTEGER) AS relevance FROM (SELECT p_partkey, t, bool_or(t = w) AS exact, bool_or(n >= {V.STEM_CHARS} AND length(t) - n <= {V.STEM_REST} AND length(w) - n <= {V.STEM_REST}) AS loose
  FROM (SELECT *, {_PREFIX} AS n FROM (SELECT p_partkey, unnest({_role_tokens('p_name')}) AS t FROM part), (SELECT unnest({_role_tokens(sql.q(_TARGET))}) AS w)) GROUP BY p_partkey, t) GROUP BY p_partkey""")
def skill_relevance(spark, sf):
    """How near each part's name is to a wanted title, by words and their stems."""
    return table(spark, sf, "part").select("p_partkey", Q.relevance(F.col("p_name"), F.lit(_TARGET)).alias("relevance"))


_ENCODED = "replace(url_encode({}), '%20', '+')"
_KEY = "array_to_string(list_filter(list_transform(string_split_regex(concat_ws(' ', CASE WHEN NOT contains(lower(title), 'senior') THEN 'Senior' END, title, p_type, 'steel -pipe'), '\\s+'), lambda t: regexp_replace(t, '^-+', '')), lambda t: t <> ''), ' ')"


@R.query(f"""SELECT p_partkey, unnest(['LinkedIn', 'Indeed', 'Google Jobs']) AS label, unnest(['https://www.linkedin.com/jobs/search/?keywords=' || k || '&location=' || l, 'https://www.indeed.com/jobs?q=' || k || '&l=' || l, 'https://www.google.com/search?q=' || k || '+jobs']) AS url
  FROM (SELECT p_partkey, {_ENCODED.format(_KEY)} AS k, {_ENCODED.format('p_brand')} AS l FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'Senior ' || p_name ELSE p_name END AS title FROM part))""")
def board_links(spark, sf):
    """Links to the search pages of three boards."""
    title = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Senior "), F.col("p_name"))).otherwise(F.col("p_name"))
    words = Q.search_keywords(F.lit("Senior"), F.array(title), F.array("p_type", F.lit("steel -pipe")))
    return table(spark, sf, "part").select("p_partkey", F.explode(Q.deep_links(words, F.col("p_brand"))).alias("l")).select("p_partkey", "l.*")


@R.query(f"""SELECT doc_id, NOT bool_or({sql.has('lower(bullet)', '(^|[^0-9a-z_])the($|[^0-9a-z_])')}) AS word_absent, bool_and({sql.words('bullet')} <= 30) AS short_enough,
  bool_and({sql.verb('bullet')}) AND count(DISTINCT {sql.swap(f'lower(string_split_regex(bullet, chr(92) || chr(115))[1])', '[^a-z]')}) = count(*) AS verbs_differ FROM ({sql.bullets()}) GROUP BY doc_id""")
def steering_adherence(spark, sf):
    return Q.adherence(B.bullets(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "the", 30)


@R.query(f"""SELECT doc_id, CASE WHEN scanned THEN 'ocr' WHEN doc_id % 5 = 0 THEN 'ner' WHEN doc_id % 4 = 0 OR doc_id % 100 / 100.0 < {V.ESCALATION_CONFIDENCE} THEN 'llm' ELSE 'none' END AS escalation, scanned OR blank AS no_text, scanned OR blank OR length(coalesce(text, '')) = 0 AS unreadable
  FROM (SELECT doc_id, text, doc_id % 7 = 0 AS scanned, trim(coalesce(text, '')) = '' AS blank FROM documents)""")
def parse_escalation(spark, sf):
    """The further pass that a parse needs, and whether its text can be judged at all."""
    i, text = F.col("doc_id"), F.col("text")
    scanned = i % 7 == 0
    return table(spark, sf, "documents").select("doc_id", Q.escalation(scanned, i % 5 == 0, F.when(i % 4 == 0, 1).otherwise(0), i % 100 / 100.0).alias("escalation"), K.no_text(scanned, text).alias("no_text"), K.unreadable(scanned, text).alias("unreadable"))


# contact cards

_FIELD = {f: f"CASE WHEN (c_custkey + {i}) % {3 + i % 4} <> 0 THEN '{f} ' || c_custkey END AS {f}, (c_custkey * {i + 3}) % 10 / 10.0 AS {f}_conf" for i, (f, _, _) in enumerate(V.CONTACT_ROWS)}
_CARDS = f"SELECT c_custkey, {', '.join(_FIELD.values())} FROM customer"


def _card_row(i: int, f: str, label: str, optional: bool) -> str:
    trusted = f"coalesce({f}, '') <> '' AND {f}_conf >= {V.CONTACT_FLOOR}"
    other = f" WHERE {trusted}" if optional else f" WHERE ({trusted}) OR NOT (coalesce(github_url, '') <> '' AND github_url_conf >= {V.CONTACT_FLOOR})" if f == "linkedin_url" else ""
    return f"SELECT c_custkey, {i} AS ord, '{f}' AS field, '{label}' AS label, coalesce({f}, '') AS value, NOT ({trusted}) AS gated, CASE WHEN coalesce({f}, '') = '' THEN 'absent' WHEN NOT ({trusted}) THEN 'low_confidence' END AS reason FROM c{other}"


_ROWS = f"WITH c AS ({_CARDS}) " + " UNION ALL ".join(_card_row(i, *r) for i, r in enumerate(V.CONTACT_ROWS))


def cards(spark: SparkSession, sf: str) -> DataFrame:
    view = as_view(table(spark, sf, "customer"))
    return Q.contact_rows(spark.sql(_CARDS.replace("FROM customer", f"FROM {view}").replace("10.0", "10D")), "c_custkey")


@R.query(_ROWS)
def contact_card(spark, sf):
    return cards(spark, sf)


@R.query(f"""SELECT c_custkey, detected, total, concat_ws(',', CASE WHEN name THEN 'full_name' END, CASE WHEN contact THEN 'contact' END, CASE WHEN none THEN 'experience' END) AS missing, NOT name AND NOT contact AND NOT none AS revealed FROM (
  SELECT c_custkey, count(*) FILTER (NOT gated) AS detected, count(*) AS total, bool_or(gated) FILTER (field = 'full_name') AS name, bool_or(gated) FILTER (field = 'email') AND bool_or(gated) FILTER (field = 'phone') AS contact,
  c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS none FROM ({_ROWS}) GROUP BY c_custkey)""")
def download_gate(spark, sf):
    """What is missing on each card before it may be used; entries are a customer's finished orders."""
    entries = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return Q.contact_gate(cards(spark, sf), "c_custkey", entries)


_PAIRS = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'certain' WHEN 1 THEN 'probable' WHEN 2 THEN 'possible' ELSE 'title-only' END AS confidence, o_custkey AS a, CAST(o_orderkey % 150 AS BIGINT) AS b FROM orders"


@R.query(f"""SELECT o_orderkey, confidence IN ('certain', 'probable') AS actionable, confidence <> 'certain' AND coalesce(x.c_nationkey = y.c_nationkey, false) AS suppressed FROM ({_PAIRS})
  LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) x ON a = x.c_custkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) y ON b = y.c_custkey""")
def pair_actions(spark, sf):
    """Pairs that may be merged, and pairs that are hidden since both sides are of one cluster (here, a nation)."""
    view = as_view(table(spark, sf, "orders"))
    pairs = spark.sql(_PAIRS.replace("FROM orders", f"FROM {view}"))
    clusters = table(spark, sf, "customer").where("c_custkey % 5 <> 0").select("c_custkey", F.col("c_nationkey").alias("cluster"))
    return K.pair_actions(pairs, clusters, "c_custkey").select("o_orderkey", "actionable", "suppressed")
