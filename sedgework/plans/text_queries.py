"""Queries over texts, lines, titles, dates, URLs and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgework.functions import text as X
from sedgework.functions import urls as U
from sedgework.functions import values as V
from sedgework.operators import bullets as B
from sedgework.operators import matching as M
from sedgework.operators import quality as Q
from sedgework.plans import samples as S
from sedgework.plans import sql
from sedgework.plans.registry import Registry
from sedgework.sources import feeds
from sedgework.sources.tables import table

R = Registry()


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


@R.query(sql.pool("doc_id", sql.features()))
def bullet_quality(spark, sf):
    """Score of each document's lines; documents without a kept line have no row."""
    return B.pool_scores(B.features(B.bullets(docs(spark, sf))), "doc_id")


@R.query(f"SELECT doc_id, CAST(ord AS INTEGER) AS ord, has_metric, verb_led, words, words BETWEEN 8 AND 30 AS in_window FROM ({sql.features()})")
def bullet_features(spark, sf):
    return B.features(B.bullets(docs(spark, sf))).drop("bullet")


@R.query(f"""SELECT coalesce(source, 'none') AS source, tier, count(*) AS docs, min(overall) AS low, max(overall) AS high
  FROM ({sql.pool('doc_id', sql.features())}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY ALL""")
def score_bands(spark, sf):
    scored = B.pool_scores(B.features(B.bullets(table(spark, sf, "documents").select("doc_id", "source", "text"))), "doc_id", "source")
    return scored.groupBy(F.coalesce("source", F.lit("none")).alias("source"), "tier").agg(F.count("*").alias("docs"), F.min("overall").alias("low"), F.max("overall").alias("high"))


@R.query(f"SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) - 1 AS VARCHAR) || '|' || key AS bullet_id FROM (SELECT doc_id, ord, {sql.key('bullet')} AS key FROM ({sql.bullets()}))")
def bullet_ids(spark, sf):
    return B.bullet_ids(B.bullets(docs(spark, sf)), "doc_id").drop("bullet")


@R.query(f"""WITH b AS (SELECT doc_id, ord, {sql.key('bullet')} AS key FROM ({sql.bullets()})), l AS (SELECT doc_id, {sql.key('line')} AS key FROM ({sql.lines()}))
  SELECT b.doc_id, CAST(b.ord AS INTEGER) AS ord, e.entry_id FROM b LEFT JOIN (SELECT key, min(doc_id) AS entry_id FROM l GROUP BY key) e USING (key)""")
def bullets_to_entries(spark, sf):
    """Each bullet with the first document that has the same line."""
    entries = B.lines(docs(spark, sf)).select(F.col("doc_id").alias("entry_id"), "line")
    return B.owners(B.bullets(docs(spark, sf)), entries).drop("bullet")


_SKIP = " OR ".join(f"contains(low, {sql.q(a)})" for a in V.BOILERPLATE_ANCHORS)


@R.query(f"""WITH l AS (SELECT id, ord, line, {sql.swap("lower(trim(line))", chr(92) + "s+", " ")} AS low FROM ({sql.lines('(SELECT id, description FROM ' + sql.values(S.POSTINGS, 'id, title, company, location, url, description, posted, pay') + ' UNION ALL SELECT doc_id + 1000, text FROM documents)', 'id', 'description')})),
  s AS (SELECT *, CASE WHEN {_SKIP} THEN true WHEN low = '' THEN false END AS state FROM l)
  SELECT id, CAST(ord AS INTEGER) AS ord, line FROM (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY id ORDER BY ord ROWS UNBOUNDED PRECEDING), false) AS skipping FROM s) WHERE NOT skipping""")
def boilerplate_strip(spark, sf):
    own = spark.createDataFrame(S.POSTINGS, S.POSTING_COLUMNS).select("id", "description")
    both = own.unionByName(docs(spark, sf).select((F.col("doc_id") + 1000).alias("id"), F.col("text").alias("description")))
    return B.strip_boilerplate(B.lines(both, "description"), "id")


@R.query(f"""SELECT doc_id, CAST(ord AS INTEGER) AS ord, is_header, last_value(CASE WHEN is_header THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section
  FROM (SELECT *, length(trim(line)) BETWEEN 1 AND 40 AND len({sql.tokens('trim(line)')}) <= 4 AND NOT {sql.has('trim(line)', '[.!?;,:]$')} AND NOT {sql.has('trim(line)', V.BULLET_MARKER)} AS is_header FROM ({sql.lines()}))""")
def section_forward_fill(spark, sf):
    return B.headers(B.lines(docs(spark, sf)), "doc_id").drop("line")


@R.query(f"""SELECT doc_id, CAST(-b.v AS INTEGER) AS mode, b.w AS weight FROM (SELECT doc_id, max({{'w': w, 'v': -n}}) AS b FROM (
  SELECT doc_id, n, CAST(sum(n) AS BIGINT) AS w FROM (SELECT doc_id, CAST(length(line) AS INTEGER) AS n FROM ({sql.lines()})) GROUP BY doc_id, n) GROUP BY doc_id)""")
def weighted_mode_length(spark, sf):
    """The line length that most characters of a document are in."""
    rows = B.lines(docs(spark, sf)).select("doc_id", F.length("line").alias("n"), F.length("line").alias("chars"))
    return B.weighted_mode(rows, "doc_id", "n", "chars")


_VERB = "trim(line)"
for _p in ("^[0-9]+[.)]\\s*", "^[•*-]\\s*", "^[*]+", "^[\"'`“‘]"):
    _VERB = f"regexp_replace({_VERB}, {sql.q(_p)}, '')"
_VERBS = f"SELECT conv_id, turn, ord, nullif(lower(regexp_extract({_VERB}, '^([A-Za-z][A-Za-z''-]+)', 1)), '') AS verb FROM ({sql.lines('conversations', 'conv_id, turn')})"


@R.query(f"SELECT conv_id, turn, CAST(ord AS INTEGER) AS ord, verb FROM ({_VERBS}) WHERE verb IS NOT NULL")
def leading_verbs(spark, sf):
    rows = B.lines(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    return rows.select("conv_id", "turn", "ord", X.leading_verb(F.col("line")).alias("verb")).where("verb is not null")


@R.query(f"""SELECT conv_id, verb, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t DESC, o DESC, verb) AS nth FROM (
  SELECT conv_id, verb, max(m).t AS t, max(m).o AS o FROM (SELECT conv_id, verb, {{'t': turn, 'o': ord}} AS m FROM ({_VERBS}) WHERE verb IS NOT NULL) GROUP BY conv_id, verb)) WHERE nth <= {V.VERB_BRIEF}""")
def recent_verbs_topk(spark, sf):
    """The last twelve different opening verbs of a conversation, latest first."""
    last = leading_verbs(spark, sf).groupBy("conv_id", "verb").agg(F.max(F.struct("turn", "ord")).alias("m"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("m.turn"), F.desc("m.ord"), "verb"))
    return last.withColumn("nth", nth).where(F.col("nth") <= V.VERB_BRIEF).drop("m")


@R.query(f"SELECT doc_id, CAST({sql.words('text')} AS INTEGER) AS words FROM documents WHERE text IS NOT NULL")
def word_count(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", X.count_words(F.col("text")).alias("words"))


_PLAIN = sql.swap("text", "[\\x00�]")
for _p, _b in (("[–—]", "-"), ("[“-‟]", '"'), ("[‘-‛]", "'"), ("…", "..."), ("[​-‍⁠﻿]", ""), (" ", " ")):
    _PLAIN = sql.swap(_PLAIN, _p, _b)


@R.query(f"SELECT conv_id, turn, {_PLAIN} AS plain FROM conversations")
def sanitize_ascii(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.for_matching(F.col("text")).alias("plain"))


@R.query(f"SELECT page_id, {sql.html_text('html')} AS plain FROM pages WHERE html IS NOT NULL")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").where("html is not null").select("page_id", X.html_text(F.col("html")).alias("plain"))


_SIGNAL = " + ".join(f"CASE WHEN {sql.has('s', p)} THEN {w} ELSE 0 END" for p, w in V.POSTING_SIGNALS)


@R.query(f"""SELECT *, score >= {V.SIGNAL_THRESHOLD} AS is_posting FROM (SELECT id, CAST({_SIGNAL} AS INTEGER) AS score FROM (
  SELECT page_id + 1000 AS id, lower({sql.html_text('html')} || chr(10) || url) AS s FROM pages WHERE html IS NOT NULL AND url IS NOT NULL
  UNION ALL SELECT id, lower(description || chr(10) || url) FROM {sql.values(S.POSTINGS, 'id, title, company, location, url, description, posted, pay')} WHERE description IS NOT NULL AND url IS NOT NULL))""")
def job_signal_score(spark, sf):
    pages = table(spark, sf, "pages").select((F.col("page_id") + 1000).alias("id"), X.html_text(F.col("html")).alias("body"), "url")
    own = spark.createDataFrame(S.POSTINGS, S.POSTING_COLUMNS).select("id", F.col("description").alias("body"), "url")
    both = pages.unionByName(own).where("body is not null and url is not null")
    scored = both.select("id", X.posting_signal(F.concat_ws("\n", "body", "url")).alias("score"))
    return scored.withColumn("is_posting", F.col("score") >= V.SIGNAL_THRESHOLD)


_URLS = f"(SELECT page_id + 1000 AS id, url FROM pages WHERE url IS NOT NULL UNION ALL SELECT id, url FROM {sql.values(S.POSTINGS, 'id, title, company, location, url, description, posted, pay')} WHERE url IS NOT NULL)"


def urls(spark, sf):
    own = spark.createDataFrame(S.POSTINGS, S.POSTING_COLUMNS).select("id", "url")
    return table(spark, sf, "pages").select((F.col("page_id") + 1000).alias("id"), "url").unionByName(own).where("url is not null")


_SLUG = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^?#]*)', 1)), '/+$', ''), '^www[.]', '')"
_PLATFORM = "CASE " + " ".join(f"WHEN {sql.has('lower(url)', p)} THEN {sql.q(n)}" for n, p in U.PLATFORMS) + " END"


@R.query(f"SELECT id, {sql.canonical('url')} AS canonical, {sql.host('url')} AS host, {_SLUG} AS slug, {_PLATFORM} AS platform FROM {_URLS}")
def canonical_url(spark, sf):
    u = F.col("url")
    return urls(spark, sf).select("id", U.canonical(u).alias("canonical"), U.host(u).alias("host"), U.slug(u).alias("slug"), U.platform(u).alias("platform"))


@R.query(f"SELECT id, first_id FROM (SELECT id, min(id) OVER (PARTITION BY c) AS first_id, count(*) OVER (PARTITION BY c) AS n FROM (SELECT id, {sql.canonical('url')} AS c FROM {_URLS}) WHERE c IS NOT NULL) WHERE n > 1")
def url_pairs(spark, sf):
    """Pages with one canonical URL, each linked to the first; a class of n pages has n rows, not n * n."""
    rows = urls(spark, sf).select("id", U.canonical(F.col("url")).alias("c")).where("c is not null")
    first = rows.groupBy("c").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("c", "first_id")
    return rows.join(first, "c").select("id", "first_id")


@R.query(f"SELECT id, {sql.seniority('title')} AS label, CAST({sql.rung(sql.seniority('title'))} AS INTEGER) AS rung FROM (SELECT id, title || ' ' || p_name AS title FROM {sql.dealt('part', 'p_partkey', S.TITLES, 'id, title', ', p_name')})")
def seniority_label(spark, sf):
    t = S.dealt(spark, sf, "part", "p_partkey", S.TITLES, "id, title").withColumn("title", F.concat_ws(" ", "title", "p_name"))
    return t.select("id", X.seniority(F.col("title")).alias("label"), X.rung(X.seniority(F.col("title"))).alias("rung"))


@R.query(f"""SELECT id, CAST(abs({sql.rung(sql.seniority('title'))} - {sql.rung(sql.seniority('other'))}) AS INTEGER) AS distance
  FROM (SELECT a.id, title, other FROM {sql.dealt('part', 'p_partkey', S.TITLES, 'id, title')} a JOIN {sql.dealt('part', 'p_partkey', S.POSTINGS, 'id, other')} b ON a.id = b.id)""")
def seniority_distance(spark, sf):
    """Rungs between two titles of each part; null where a level is unknown."""
    t = S.dealt(spark, sf, "part", "p_partkey", S.TITLES, "id, title").select("id", "title")
    t = t.join(S.dealt(spark, sf, "part", "p_partkey", S.POSTINGS, "id, other").select("id", "other"), "id")
    rung = lambda c: X.rung(X.seniority(F.col(c)))
    return t.select("id", F.abs(rung("title") - rung("other")).alias("distance"))


@R.query(f"SELECT p_partkey, unnest({sql.title_tokens('p_name')}) AS token FROM part")
def title_tokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(X.title_tokens(F.col("p_name"))).alias("token"))


@R.query(f"""SELECT doc_id, list_count(t) AS tokens, len(list_filter(t, lambda x: length(x) >= 3 AND x NOT IN ({', '.join(map(sql.q, V.QUERY_STOPWORDS))}))) AS admitting,
  len(list_filter(t, lambda x: x NOT IN ({', '.join(map(sql.q, V.QUERY_STOPWORDS))}) AND (length(x) >= 3 OR regexp_matches(x, '[^a-z0-9]')))) AS significant FROM (SELECT doc_id, {sql.title_tokens('text')} AS t FROM documents WHERE text IS NOT NULL)""".replace("list_count(t)", "CAST(len(t) AS INTEGER)").replace("len(list_filter(t, lambda x: length(x) >= 3", "CAST(len(list_filter(t, lambda x: length(x) >= 3").replace(")) AS admitting", ")) AS INTEGER) AS admitting").replace("len(list_filter(t, lambda x: x NOT IN", "CAST(len(list_filter(t, lambda x: x NOT IN").replace(")) AS significant", ")) AS INTEGER) AS significant"))
def significant_terms(spark, sf):
    t = docs(spark, sf).where("text is not null").select("doc_id", X.title_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.size(F.filter("t", X.admitting_term)).alias("admitting"), F.size(F.filter("t", X.significant_skill)).alias("significant"))


@R.query(f"SELECT id, lower(posting) <> '' AND {sql.has('lower(posting)', sql.START + '(remote|worldwide|anywhere|wfh)' + sql.END)} AS remote, ({sql.has('lower(posting)', sql.START + '(remote|worldwide|anywhere|wfh)' + sql.END)}) OR (w <> '' AND p <> '' AND (trim(string_split(w, ',')[1]) = trim(string_split(p, ',')[1]) OR contains(p, w) OR contains(w, p))) AS matches FROM (SELECT *, lower(trim(wanted)) AS w, lower(trim(posting)) AS p FROM (SELECT id, wanted || CASE WHEN p_size % 7 = 0 THEN p_name ELSE '' END AS wanted, posting FROM {sql.dealt('part', 'p_partkey', S.PLACES, 'id, wanted, posting', ', p_size, p_name')}))")
def location_match(spark, sf):
    t = S.dealt(spark, sf, "part", "p_partkey", S.PLACES, "id, wanted, posting").withColumn("wanted", F.concat("wanted", F.when(F.col("p_size") % 7 == 0, F.col("p_name")).otherwise("")))
    return t.select("id", X.is_remote(F.col("posting")).alias("remote"), X.place_matches(F.col("wanted"), F.col("posting")).alias("matches"))


_MONTH = "CASE lower(m) " + " ".join(f"WHEN {sql.q(k)} THEN {sql.q(v)}" for k, v in V.MONTHS.items()) + " END"


@R.query(f"""SELECT id, CASE WHEN {_MONTH} IS NOT NULL THEN regexp_extract(s, '([0-9]{{4}})$', 1) || '-' || {_MONTH} WHEN try_cast(b AS INT) BETWEEN 1 AND 12 THEN regexp_extract(s, '([0-9]{{4}})$', 1) || '-' || lpad(b, 2, '0')
  WHEN try_cast(f AS INT) BETWEEN 1 AND 12 THEN substr(s, 1, 4) || '-' || lpad(f, 2, '0') ELSE s END AS iso FROM (SELECT id, s, regexp_extract(s, '^([A-Za-z]{{3,9}})[.]?\\s+[0-9]{{4}}$', 1) AS m,
  regexp_extract(s, '^([0-9]{{1,2}})/[0-9]{{4}}$', 1) AS b, regexp_extract(s, '^[0-9]{{4}}/([0-9]{{1,2}})$', 1) AS f FROM (SELECT id, trim(raw) AS s FROM {sql.dealt('orders', 'o_orderkey', S.DATES, 'id, raw')}))""")
def iso_month_date(spark, sf):
    return S.dealt(spark, sf, "orders", "o_orderkey", S.DATES, "id, raw").select("id", X.iso_month(F.col("raw")).alias("iso"))


@R.query(f"SELECT doc_id, unnest(regexp_extract_all(text, {sql.q('(' + V.EMAIL + ')')}, 1)) AS email FROM documents")
def email_extract(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(X.emails(F.col("text"))).alias("email"))


@R.query(f"""SELECT doc_id, email, lower(string_split(email, '@')[2]) IN ({', '.join(map(sql.q, V.FREE_MAIL))}) AS free_mail, NOT contains({sql.flat('text')}, list_extract(string_split(lower(string_split(email, '@')[2]), '.'), -2)) AS mismatch
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, {sql.q('(' + V.EMAIL + ')')}, 1)) AS email, regexp_replace(text, {sql.q(V.EMAIL)}, ' ', 'g') AS text FROM documents)""")
def email_domain_mismatch(spark, sf):
    """Whether the owner of an address' domain is named nowhere else in the text."""
    rows = docs(spark, sf).select("doc_id", F.explode(X.emails(F.col("text"))).alias("email"), F.regexp_replace("text", V.EMAIL, " ").alias("rest"))
    domain = F.lower(F.split("email", "@")[1])
    return rows.select("doc_id", "email", domain.isin(*V.FREE_MAIL).alias("free_mail"), (~X.flat(F.col("rest")).contains(F.element_at(F.split(domain, "[.]"), -2))).alias("mismatch"))


@R.query(f"SELECT doc_id, nullif(regexp_extract(text, {sql.q(V.PHONE)}, 0), '') AS phone FROM documents WHERE {sql.has('text', V.PHONE)}")
def nanp_phone_extract(spark, sf):
    return docs(spark, sf).select("doc_id", X.first_phone(F.col("text")).alias("phone")).where("phone is not null")


@R.query("""SELECT coalesce(lang, 'none') AS lang, count(*) AS docs, count(*) FILTER (length(text) >= 40 AND len(list_filter(string_split_regex(text, '\\s+'), lambda t: length(t) = 1)) / len(string_split_regex(text, '\\s+')) > 0.3) AS garbled FROM documents GROUP BY ALL""")
def garbled_flag(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("docs"), F.count(F.when(X.garbled(F.col("text")), 1)).alias("garbled"))


@R.query("SELECT CASE WHEN n_chars < 100 THEN '0-100kb' WHEN n_chars < 300 THEN '100-300kb' WHEN n_chars < 600 THEN '300-600kb' WHEN n_chars < 1000 THEN '600-1000kb' ELSE '1000kb+' END AS bucket, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def size_bucket(spark, sf):
    """Documents by the size buckets, a character standing for a kilobyte."""
    d = table(spark, sf, "documents")
    return d.groupBy(X.size_bucket(F.col("n_chars")).alias("bucket")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


_COVERED = [f"list_contains(w, {sql.q(t)})" for t, _ in S.TERMS]


@R.query(f"""SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN {sql.q(t)} END" for c, (t, _) in zip(_COVERED, S.TERMS, strict=True))}], lambda x: x IS NOT NULL), ',') AS covered,
  CAST({' + '.join(f"CAST({c} AS INTEGER)" for c in _COVERED)} AS INTEGER) AS n_covered, CAST(floor(({' + '.join(f"CASE WHEN {c} THEN {w} ELSE 0.0 END" for c, (_, w) in zip(_COVERED, S.TERMS, strict=True))}) / {sum(w for _, w in S.TERMS)} * 100 + 0.5) AS INTEGER) AS score
  FROM (SELECT doc_id, list_distinct(string_split({sql.flat('text')}, ' ')) AS w FROM documents)""")
def dictionary_coverage(spark, sf):
    return M.coverage(docs(spark, sf), "text", S.TERMS).drop("text")


def _sector_sql() -> str:
    hits = ", ".join(f"{{'hits': {' + '.join(f'CAST({sql.has(str().join(chr(115)), sql.START + p + sql.END)} AS INTEGER)' for p in ps)}, 'k': {-k}, 'sector': {sql.q(n)}}}" for k, (n, ps) in enumerate(V.SECTORS.items()))
    return f"""SELECT id, CASE WHEN r[1].hits >= 1 THEN r[1].sector ELSE 'other' END AS sector, CAST(r[1].hits AS INTEGER) AS hits, CASE WHEN r[1].hits >= 1 AND r[2].hits >= 1 THEN r[2].sector END AS runner_up,
      CASE WHEN r[1].hits >= 1 THEN r[1].hits / (r[1].hits + r[2].hits) * least(1.0, r[1].hits / 3) ELSE 0.0 END AS confidence FROM (SELECT id, list_reverse_sort([{hits}]) AS r FROM (
      SELECT CAST(id AS BIGINT) AS id, lower(coalesce(description, '')) AS s FROM {sql.values(S.POSTINGS, 'id, title, company, location, url, description, posted, pay')} UNION ALL SELECT item_id + 1000, lower(coalesce(text, '')) FROM benchmark))"""


@R.query(_sector_sql())
def sector_vote(spark, sf):
    own = spark.createDataFrame(S.POSTINGS, S.POSTING_COLUMNS).select("id", "description")
    both = own.unionByName(table(spark, sf, "benchmark").select((F.col("item_id") + 1000).alias("id"), F.col("text").alias("description")))
    return M.sector_scores(both, "description").drop("description")


_PHRASE = "(?:^|[^A-Za-z0-9_&-])([A-Z][A-Za-z][A-Za-z&-]*(?:[ \\t]+[A-Z][A-Za-z][A-Za-z&-]*){1,3})"
_ACRONYM = "(?:^|[^A-Za-z0-9_])([A-Z][A-Z0-9]{1,5})"


@R.query(f"""SELECT doc_id, phrase, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, phrase) AS place FROM (SELECT doc_id, lower(p) AS phrase, count(*) AS n FROM (
  SELECT doc_id, unnest(list_concat(regexp_extract_all(text, {sql.q(_PHRASE)}, 1), regexp_extract_all(text, {sql.q(_ACRONYM)}, 1))) AS p FROM documents) GROUP BY ALL)) WHERE place <= 25""")
def noun_topk(spark, sf):
    """The 25 most frequent capitalised phrases and acronyms of each document."""
    found = M.noun_phrases(docs(spark, sf), "doc_id", "text")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "phrase"))
    return found.withColumn("place", nth).where("place <= 25")


@R.query(f"""SELECT id, pay_min, pay_max, period, CASE WHEN year >= {V.LEAST_ANNUAL_PAY} THEN year END AS annual, coalesce(year < 100000, false) AS below FROM (SELECT *, CASE period WHEN 'hour' THEN pay_max * 2080 WHEN 'month' THEN pay_max * 12 ELSE pay_max END AS year FROM (
  SELECT id, CASE WHEN a <> '' THEN CAST(replace(a, ',', '') AS DOUBLE) * CASE WHEN coalesce(nullif(ka, ''), kb) <> '' THEN 1000 ELSE 1 END END AS pay_min, CASE WHEN b <> '' THEN CAST(replace(b, ',', '') AS DOUBLE) * CASE WHEN kb <> '' THEN 1000 ELSE 1 END END AS pay_max,
  CASE WHEN a <> '' THEN CASE WHEN u IN ('hour', 'hr') THEN 'hour' WHEN u IN ('month', 'mo') THEN 'month' ELSE 'year' END END AS period FROM (SELECT id, {', '.join(f"regexp_extract(pay, {sql.q('[$]' + chr(92) + 's*([0-9][0-9,]*(?:[.][0-9]+)?)' + chr(92) + 's*([Kk])?' + chr(92) + 's*(?:-|–|—|to)' + chr(92) + 's*[$]' + chr(92) + 's*([0-9][0-9,]*(?:[.][0-9]+)?)' + chr(92) + 's*([Kk])?' + chr(92) + 's*(?:/|per |an? )?' + chr(92) + 's*(hour|hr|month|mo|year|yr)?')}, {k}) AS {n}" for k, n in enumerate(('a', 'ka', 'b', 'kb', 'u'), 1))}
  FROM (SELECT id, CASE WHEN p_size % 5 = 0 THEN '$' || (p_size * 1000) || ' - $' || (p_size * 1500) || ' a year' ELSE pay END AS pay FROM {sql.dealt('part', 'p_partkey', [(i, p) for i, *_, p in S.POSTINGS], 'id, pay', ', p_size')}))))""")
def compensation_extract(spark, sf):
    p = S.dealt(spark, sf, "part", "p_partkey", [(i, pay) for i, *_, pay in S.POSTINGS], "id, pay")
    n = F.col("p_size")
    p = p.withColumn("pay", F.when(n % 5 == 0, F.concat(F.lit("$"), n * 1000, F.lit(" - $"), n * 1500, F.lit(" a year"))).otherwise(F.col("pay")))
    out = Q.pay_range(p, "pay")
    return out.select("id", "pay_min", "pay_max", "period", M.annual_pay(F.col("pay_max"), F.col("period")).alias("annual"), M.below_floor(F.col("pay_min"), F.col("pay_max"), F.col("period"), F.lit("USD"), 100000.0).alias("below"))


def _feed_sql() -> str:
    g = lambda n: f"json_extract_string(j, '$.{n}')"
    parts = {
        "remotive": (g("id"), g("title"), g("company_name"), g("candidate_required_location"), g("url"), g("description"), f"substr({g('publication_date')}, 1, 10)"),
        "jobicy": (g("id"), g("jobTitle"), g("companyName"), g("jobGeo"), g("url"), g("jobDescription"), f"substr({g('pubDate')}, 1, 10)"),
        "arbeitnow": (g("slug"), g("title"), g("company_name"), g("location"), g("url"), g("description"), f"strftime(epoch_ms(CAST({g('created_at')} AS BIGINT) * 1000), '%Y-%m-%d')"),
        "lever": (g("id"), g("text"), "'Food Co'", g("categories.location"), g("hostedUrl"), g("descriptionPlain"), f"strftime(epoch_ms(CAST({g('createdAt')} AS BIGINT)), '%Y-%m-%d')"),
    }
    raw = f"(SELECT feed, CASE WHEN json_valid(json) THEN json END AS j FROM (SELECT feed, replace(json, 'Data Engineer', p_name) AS json FROM {sql.dealt('part', 'p_partkey', S.FEED_ROWS, 'id, feed, json', ', p_name')}))"
    each = [f"SELECT {sql.q(f + ':')} || {i} AS id, trim({t}) AS title, trim(coalesce({c}, '')) AS company, coalesce({p}, '') AS location, {u} AS url, {sql.html_text(f'coalesce({d}, {sql.q(str())})')} AS description, {at} AS posted_at, {sql.q(f)} AS source FROM {raw} WHERE feed = {sql.q(f)} AND length(trim({t})) > 0 AND regexp_matches(lower({u}), '^https?://')" for f, (i, t, c, p, u, d, at) in parts.items()]
    return " UNION ALL ".join(each)


@R.query(_feed_sql())
def feed_postings(spark, sf):
    """All parts as rows of feeds."""
    raw = S.dealt(spark, sf, "part", "p_partkey", S.FEED_ROWS, "id, feed, json").withColumn("json", F.replace("json", F.lit("Data Engineer"), F.col("p_name")))
    return feeds.union([feeds.postings(raw.where(F.col("feed") == f), f, "Food Co" if f == "lever" else None) for f in feeds.FEEDS])


def turns(spark, sf, rows, names):
    """All turns of conversations with values beside them; ``id`` is unlike for each."""
    key = F.col("conv_id") * 100 + F.col("turn")
    c = table(spark, sf, "conversations").withColumn("id", key)
    return c.withColumns({n: F.element_at(F.array(*[F.lit(r[k + 1]).cast("string") for r in rows]), (F.col("id") % len(rows) + 1).cast("int")) for k, n in enumerate(names)})


@R.query()
def markdown_plain(spark, sf):
    """Every turn behind a piece of markdown, as plain text."""
    t = turns(spark, sf, S.MARKDOWN, ["md"])
    return t.select("id", feeds.markdown_text(F.concat_ws("\n", "md", "text")).alias("plain"))


@R.query()
def markdown_links(spark, sf):
    """The link definitions of every turn."""
    return feeds.link_definitions(turns(spark, sf, S.MARKDOWN, ["md"]).select("id", F.concat_ws("\n", "text", "md").alias("md")), "id", "md")


@R.query()
def json_repair(spark, sf):
    """The object in every turn: the turn itself in JSON, with text around it."""
    t = turns(spark, sf, S.ANSWERS, ["raw"])
    said = F.to_json(F.struct("role", F.col("text").alias("said")))
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Here: "), said, F.lit(" as asked"))).otherwise(F.col("raw"))
    return t.withColumn("raw", raw).select("id", Q.repaired_json("raw").alias("json"))
