"""Queries over records: doubles, clusters, joins, windows, sets, the store, quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgework.functions import text as X
from sedgework.functions import urls as U
from sedgework.functions import values as V
from sedgework.operators import bullets as B
from sedgework.operators import checks as K
from sedgework.operators import matching as M
from sedgework.operators import quality as Q
from sedgework.operators import records as D
from sedgework.operators import store as S
from sedgework.plans import samples, sql
from sedgework.plans.registry import Registry
from sedgework.sources.tables import table
from sedgework.streaming import events as E

R = Registry()
AS_OF = "2024-02-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as postings: a customer's firms have the customer's number before their names."""
    p = samples.dealt(spark, sf, "orders", "o_orderkey", samples.POSTINGS, "id, title, company, location, url, description, posted, pay")
    own = F.col("o_custkey").cast("string")
    url = F.concat(F.substring_index("url", "#", 1), F.when(F.col("url").contains("?"), "&k=").otherwise("?k="), own)
    return p.select("id", U.canonical(url).alias("url"), F.concat_ws(" ", own, "company").alias("company"), "title", F.col("description").alias("body"), "posted", F.col("location").alias("place"), "pay", F.to_timestamp("posted").alias("at"))


_P = "(SELECT id, cust, title, cust || ' ' || company AS company, location, string_split(url, '#')[1] || CASE WHEN contains(url, '?') THEN '&k=' ELSE '?k=' END || cust AS url, description, posted, pay FROM " + sql.dealt(
    "orders", "o_orderkey", samples.POSTINGS, "id, title, company, location, url, description, posted, pay", ", o_custkey AS cust"
) + ")"
_COMPANY = f"regexp_replace({sql.flat('company')}, '( ({'|'.join(V.LEGAL_SUFFIXES)}))+$', '')"


def _contain(a: str, b: str) -> str:
    return f"(CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0 END)"


def _set(x: str, least: int) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: length(t) >= {least}))"


@R.query(f"""WITH p AS (SELECT CAST(id AS BIGINT) AS id, cust, {sql.canonical('url')} AS url, {_COMPANY} AS company, {sql.flat('title')} AS title, {sql.flat('description')} AS body, {sql.flat('posted')} AS posted, {sql.flat('location')} AS place, {sql.flat('pay')} AS pay, CAST(posted AS DATE) AS at FROM {_P})
  SELECT * FROM (SELECT a.id AS a, b.id AS b, CASE WHEN a.url = b.url THEN 'certain' WHEN a.company = '' OR a.company <> b.company THEN NULL
    WHEN a.title <> '' AND a.title = b.title THEN CASE WHEN (a.body <> '' AND a.body = b.body) OR (a.posted <> '' AND a.posted = b.posted) OR (a.place <> '' AND a.place = b.place AND a.pay <> '' AND a.pay = b.pay) OR abs(a.at - b.at) <= {V.REPOST_SPAN_DAYS} THEN 'probable' ELSE 'title-only' END
    WHEN {_contain(_set('a.title', 1), _set('b.title', 1))} >= {V.SIMILAR_TITLE} AND {_contain(_set('a.body', 3), _set('b.body', 3))} >= {V.OVERLAPPING_TEXT} THEN 'possible' END AS confidence
  FROM p a JOIN p b ON a.cust = b.cust AND a.id < b.id) WHERE confidence IS NOT NULL""")
def duplicate_pairs(spark, sf):
    return D.candidate_pairs(postings(spark, sf))


@R.query(f"""SELECT o_custkey, o_orderpriority, a.o_orderkey AS a, b.o_orderkey AS b, abs(epoch(a.o_orderdate) - epoch(b.o_orderdate)) / 86400 AS days
  FROM orders a JOIN orders b USING (o_custkey, o_orderpriority) WHERE a.o_orderkey < b.o_orderkey AND abs(epoch(a.o_orderdate) - epoch(b.o_orderdate)) <= {V.REPOST_SPAN_DAYS * 86400}""")
def range_span_pairs(spark, sf):
    """Orders of one customer and priority within 21 days of each other."""
    return D.pairs_within_days(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", "o_orderdate")


_CLUSTERS = f"""SELECT o_custkey, o_orderpriority, count(*) AS members, CASE WHEN count(*) = count(o_orderdate) THEN min(o_orderdate) END AS first_seen, CASE WHEN count(*) = count(o_orderdate) THEN max(o_orderdate) END AS last_seen,
  CASE WHEN count(*) = count(o_orderdate) THEN {sql.half('(epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400')} END AS span_days FROM orders GROUP BY ALL
  HAVING count(*) >= 2 AND (count(*) <> count(o_orderdate) OR (epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400 > {V.REPOST_SPAN_DAYS})"""


@R.query(_CLUSTERS)
def repost_clusters(spark, sf):
    return D.repost_clusters(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate")


@R.query(f"SELECT o_orderkey, o_custkey FROM orders SEMI JOIN ({_CLUSTERS}) USING (o_custkey, o_orderpriority) WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01'")
def cluster_member_semi(spark, sf):
    """Open orders older than the cutoff that are in a cluster."""
    o = table(spark, sf, "orders")
    old = o.where("o_orderstatus = 'O' and o_orderdate < timestamp '1997-01-01'")
    return old.join(repost_clusters(spark, sf), ["o_custkey", "o_orderpriority"], "left_semi").select("o_orderkey", "o_custkey")


@R.query("SELECT count(*) AS n, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen, count(*) = count(o_orderdate) AS all_usable, o_orderpriority FROM orders GROUP BY ALL")
def captured_span(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"), (F.count("*") == F.count("o_orderdate")).alias("all_usable"))


@R.query("SELECT event_id, CASE WHEN c.c_custkey IS NULL THEN NULL ELSE user_id END AS user_id, c.c_custkey IS NULL AND user_id IS NOT NULL AS dangling FROM events LEFT JOIN customer c ON user_id = c_custkey AND c_mktsegment <> 'BUILDING'")
def dangling_links_anti(spark, sf):
    """Events whose user is none of the kept customers lose the link."""
    kept = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'")
    return S.clear_dangling(table(spark, sf, "events"), "user_id", kept, "c_custkey").select("event_id", "user_id", "dangling")


_PT = f"SELECT p_partkey AS title_id, {sql.title_tokens('p_name')} AS t FROM part"
_PP = f"SELECT profile, list_distinct({sql.title_tokens('name')}) AS t FROM {sql.values(samples.PROFILES, 'profile, name')}"


@R.query(f"SELECT title_id, CAST(profile AS INTEGER) AS profile, CAST(100 + 10 * len(b.t) AS BIGINT) AS score FROM ({_PT}) a JOIN ({_PP}) b ON len(b.t) > 0 AND list_has_all(a.t, b.t)")
def profile_subset_match(spark, sf):
    titles = table(spark, sf, "part").select(F.col("p_partkey").alias("title_id"), F.col("p_name").alias("title"))
    return M.contained_profiles(titles, spark.createDataFrame(samples.PROFILES, "profile int, name string"))


@R.query(f"""WITH v AS (SELECT owner, profile, CAST(sum(10 + greatest(0, 5 - rank)) AS BIGINT) AS score, count(*) AS shared FROM (SELECT DISTINCT l_suppkey AS owner, p_type AS k FROM lineitem JOIN part ON l_partkey = p_partkey) JOIN (
    SELECT p_brand AS profile, p_type AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS rank FROM (SELECT DISTINCT p_brand, p_type FROM part)) USING (k) GROUP BY ALL HAVING count(*) >= 2)
  SELECT owner, profile, score, shared, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, profile) AS place FROM v) WHERE place <= 5""")
def profile_skill_votes(spark, sf):
    """The brands whose part types a supplier shares most."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    skills = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("owner"), F.col("p_type").alias("skill"))
    kinds = part.select(F.col("p_brand").alias("profile"), F.col("p_type").alias("skill")).distinct()
    ranked = kinds.withColumn("rank", F.row_number().over(Window.partitionBy("profile").orderBy("skill")) - 1)
    return M.profile_votes(skills, ranked)


@R.query("SELECT p.event_id, p.user_id, p.ts, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) s ON p.user_id = s.user_id AND p.ts >= s.ts")
def coursework_asof(spark, sf):
    """Each purchase with the user's latest sign-up before it."""
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"), "event_id")
    return M.as_of(left, right, "user_id", "ts", "signup_id", "event_id")


@R.query("""SELECT model, variant, coalesce(n, 0) AS n, best FROM (SELECT * FROM (VALUES ('small'), ('medium'), ('large')) m(model), (VALUES ('baseline'), ('terse'), ('examples')) v(variant))
  LEFT JOIN (SELECT split_part(p_name, ' ', 1) AS model, CASE WHEN p_size < 17 THEN 'baseline' WHEN p_size < 34 THEN 'terse' ELSE 'examples' END AS variant, count(*) AS n, max(p_retailprice) AS best FROM part GROUP BY ALL) USING (model, variant)""")
def model_matrix_cross(spark, sf):
    """Every cell of models by variants, also those without a result."""
    cells = spark.createDataFrame(samples.MODELS, "i int, model string").select("model").crossJoin(spark.createDataFrame(samples.VARIANTS, "j int, variant string").select("variant"))
    variant = F.when(F.col("p_size") < 17, "baseline").when(F.col("p_size") < 34, "terse").otherwise("examples")
    got = table(spark, sf, "part").groupBy(F.split("p_name", " ")[0].alias("model"), variant.alias("variant")).agg(F.count("*").alias("n"), F.max("p_retailprice").alias("best"))
    return cells.join(got, ["model", "variant"], "left").select("model", "variant", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "best")


@R.query("SELECT item, fixture, CAST(differing AS INTEGER) AS differing, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY differing, fixture) AS place FROM (SELECT p_partkey AS item, f.fixture, CAST(p_brand <> f.brand AS INT) + CAST(p_type <> f.kind AS INT) + CAST((p_size <= 25) <> f.small AS INT) AS differing FROM part, (VALUES (1, 'Brand#1', 'SMALL', true), (2, 'Brand#2', 'ECONOMY', true), (3, 'Brand#3', 'LARGE', false), (4, 'Brand#4', 'PROMO', false)) f(fixture, brand, kind, small))) WHERE place <= 3")
def fixture_nearest_miss(spark, sf):
    """The three of four literal fixtures that differ from a part in the fewest of three axes; the fixtures are part of the plan."""
    fixtures = [(1, "Brand#1", "SMALL", True), (2, "Brand#2", "ECONOMY", True), (3, "Brand#3", "LARGE", False), (4, "Brand#4", "PROMO", False)]
    miss = lambda b, k, s: (F.col("p_brand") != b).cast("int") + (F.col("p_type") != k).cast("int") + ((F.col("p_size") <= 25) != F.lit(s)).cast("int")
    ranked = F.slice(F.array_sort(F.array(*[F.struct(miss(b, k, s).alias("differing"), F.lit(i).alias("fixture")) for i, b, k, s in fixtures])), 1, 3)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.posexplode(ranked).alias("p", "f")).select("item", "f.fixture", "f.differing", (F.col("p") + 1).alias("place"))


@R.query("SELECT event_id, user_id, gap FROM (SELECT event_id, user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS g, CASE WHEN round(g, 3) > 0 THEN CAST(round(g, 3) AS DOUBLE) END AS gap FROM events)")
def line_gap_lag(spark, sf):
    """Seconds since the row above of the same group, where positive."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seconds = lambda t: F.unix_micros(t.cast("timestamp")) / 1e6
    gap = F.round(seconds(F.col("ts")) - seconds(before), 3)
    return table(spark, sf, "events").select("event_id", "user_id", F.when(gap > 0, gap).alias("gap"))


@R.query("SELECT p_partkey, p_brand, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(p_brand)) ORDER BY p_partkey) AS nth FROM part) WHERE nth <= 8")
def cap_per_company(spark, sf):
    return D.cap_per_group(table(spark, sf, "part").select("p_partkey", "p_brand"), F.lower(F.trim("p_brand")), "p_partkey")


@R.query("SELECT p_partkey, p_name, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name), p_brand ORDER BY p_partkey) = 1")
def first_wins_dedup(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return D.first_wins(p, F.concat_ws("::", F.lower("p_name"), "p_brand"), "p_partkey")


@R.query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY s, p_partkey) AS nth FROM (SELECT 0 AS s, p_partkey, p_name FROM part WHERE p_size > 25 UNION ALL SELECT 1, p_partkey, p_name FROM part WHERE p_type = 'SMALL')) WHERE nth = 1")
def union_distinct_merge(spark, sf):
    p = table(spark, sf, "part")
    return D.union_first_wins(p.where("p_size > 25").select("p_partkey", "p_name"), p.where("p_type = 'SMALL'").select("p_partkey", "p_name"), F.lower("p_name"), "p_partkey")


_SIDE = "SELECT DISTINCT c_nationkey, c_mktsegment, CAST(floor(c_acctbal) AS BIGINT) AS balance FROM customer WHERE c_custkey % "


@R.query(f"""WITH a AS ({_SIDE} 2 = 0), b AS ({_SIDE} 3 = 0) SELECT *, 'missing' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'extra' FROM (FROM b EXCEPT FROM a)""")
def skills_except_diff(spark, sf):
    """What each of two sets of customers' features has alone."""
    rows = table(spark, sf, "customer")
    part = lambda k: rows.where(F.col("c_custkey") % k == 0).select("c_nationkey", "c_mktsegment", F.floor("c_acctbal").alias("balance")).distinct()
    return D.except_both(part(2), part(3))


_TURNS = "(SELECT conv_id, a.turn AS turn, a.text AS before, b.text AS after FROM conversations a JOIN conversations b USING (conv_id) WHERE b.turn = a.turn + 1)"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn of a conversation (``before``) with the next (``after``)."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.withColumnRenamed("text", "before").join(after, ["conv_id", "turn"])


def _turns_sets() -> str:
    a, b = (f"list_distinct(list_filter(string_split({sql.flat(x)}, ' '), lambda t: length(t) >= 1))" for x in ("before", "after"))
    return f"SELECT conv_id, turn, CASE WHEN u > 0 THEN i / u ELSE 1.0 END AS jaccard FROM (SELECT conv_id, turn, len(list_intersect(a, b)) AS i, len(a) + len(b) - len(list_intersect(a, b)) AS u FROM (SELECT conv_id, turn, {a} AS a, {b} AS b FROM {_TURNS}))"


@R.query(_turns_sets())
def jaccard_sets(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", X.jaccard(X.token_set(F.col("before")), X.token_set(F.col("after"))).alias("jaccard"))


def _words(x: str) -> str:
    return sql.tokens(sql.key(f"coalesce({x}, '')"))


@R.query(f"""WITH t AS (SELECT conv_id, turn, {_words('before')} AS a, {_words('after')} AS b FROM {_TURNS}), w AS (SELECT conv_id, turn, w, count(*) FILTER (s = 0) AS l, count(*) FILTER (s = 1) AS r FROM (SELECT conv_id, turn, unnest(a) AS w, 0 AS s FROM t UNION ALL SELECT conv_id, turn, unnest(b), 1 FROM t) GROUP BY ALL)
  SELECT conv_id, turn, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE coalesce(s, 0) * 2 / (len(a) + len(b)) END AS dice FROM t LEFT JOIN (SELECT conv_id, turn, CAST(sum(least(l, r)) AS BIGINT) AS s FROM w GROUP BY ALL) USING (conv_id, turn)""")
def multiset_dice(spark, sf):
    return Q.multiset_dice(turns(spark, sf), ["conv_id", "turn"], "before", "after")


def _numbers(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(coalesce({x}, ''), '([0-9][0-9,.]*)', 1), lambda n: regexp_replace(replace(n, ',', ''), '[.]+$', '')))"


@R.query(f"""SELECT *, dropped = '' AND added = '' AS preserved FROM (SELECT conv_id, turn, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS dropped, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS added FROM (SELECT conv_id, turn, {_numbers('before')} AS a, {_numbers('after')} AS b FROM {_TURNS}))""")
def number_preservation(spark, sf):
    return Q.number_changes(turns(spark, sf), "before", "after").select("conv_id", "turn", "dropped", "added", "preserved")


@R.query()
def align_bullets(spark, sf):
    """Lines of each turn aligned with those of the next."""
    return Q.align_lines(turns(spark, sf), "before", "after")


@R.query()
def word_diff(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.posexplode(Q.word_diff("before", "after")).alias("ord", "d")).select("conv_id", "turn", "ord", "d.kind", "d.text")


@R.query(f"""WITH u AS (SELECT user_id, max(event_id) AS last_id, max_by(event_type, event_id) AS kind FROM events GROUP BY user_id)
  SELECT coalesce(c_custkey, user_id) AS id, CASE WHEN user_id IS NOT NULL THEN kind ELSE c_mktsegment END AS status, c_name AS name, coalesce(CASE WHEN c_custkey IS NOT NULL THEN TIMESTAMP '2023-01-01' END, TIMESTAMP '{AS_OF}') AS created_at, CASE WHEN user_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '2023-01-01' END AS updated_at FROM customer FULL JOIN u ON c_custkey = user_id""")
def upsert_touch(spark, sf):
    """Customers, with the last event of each user as their new status."""
    t0 = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("name"), t0.alias("created_at"), t0.alias("updated_at"))
    last = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", "event_id").alias("status"))
    return S.upsert(base, last, "id", as_of())


def job_table(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records of a store."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))


def doomed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a returned line."""
    return table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))


_DELETED = f"(SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN d THEN TIMESTAMP '{AS_OF}' ELSE o_orderdate END AS updated_at, CASE WHEN d THEN TIMESTAMP '{AS_OF}' END AS deleted_at FROM (SELECT *, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS d FROM orders))"


@R.query(f"SELECT status, count(*) AS n FROM {_DELETED} WHERE deleted_at IS NULL GROUP BY status")
def tombstone_live(spark, sf):
    gone = S.soft_delete(job_table(spark, sf), doomed(spark, sf), "id", as_of())
    return S.live(gone).groupBy("status").agg(F.count("*").alias("n"))


@R.query(f"SELECT id, updated_at, deleted_at FROM {_DELETED} WHERE updated_at > TIMESTAMP '1998-06-01'")
def updated_since(spark, sf):
    """What changed after the cursor, tombstones too."""
    gone = S.soft_delete(job_table(spark, sf), doomed(spark, sf), "id", as_of())
    return S.updated_since(gone, F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")).select("id", "updated_at", "deleted_at")


@R.query("SELECT o_orderkey AS id, swept, CASE WHEN swept THEN 'archived' ELSE o_orderstatus END AS status FROM (SELECT *, coalesce(o_orderstatus = 'O' AND epoch(TIMESTAMP '1998-12-01') - epoch(o_orderdate) > 365 * 86400, false) AS swept FROM orders)")
def archive_sweep(spark, sf):
    return S.sweep(job_table(spark, sf), "O", "archived", F.lit("1998-12-01 00:00:00").cast("timestamp_ntz"), 365).select("id", "swept", "status")


@R.query("SELECT p_name, min(p_partkey) AS p_partkey, count(*) AS merged, min_by(p_brand, p_partkey) FILTER (p_brand IS NOT NULL AND trim(p_brand) <> '') AS p_brand, min_by(p_type, p_partkey) FILTER (p_type IS NOT NULL AND p_type <> '') AS p_type FROM (SELECT p_name, p_partkey, CASE WHEN p_size > 20 THEN p_brand END AS p_brand, CASE WHEN p_size < 40 THEN p_type ELSE '' END AS p_type FROM part) GROUP BY p_name")
def merge_fill_missing(spark, sf):
    p = table(spark, sf, "part").select("p_name", "p_partkey", F.when(F.col("p_size") > 20, F.col("p_brand")).alias("p_brand"), F.when(F.col("p_size") < 40, F.col("p_type")).otherwise("").alias("p_type"))
    return D.fill_missing(p, ["p_name"], "p_partkey", ["p_brand", "p_type"])


@R.query("SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN c_acctbal >= 0 THEN NULL ELSE 'balance' END, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE 'segment' END, CASE WHEN c_nationkey < 20 THEN NULL ELSE 'nation' END], lambda x: x IS NOT NULL), ',') AS reasons, coalesce(c_acctbal >= 0, false) AND coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false) AND coalesce(c_nationkey < 20, false) AS ok FROM customer")
def validate_records(spark, sf):
    rules = [("balance", F.col("c_acctbal") >= 0), ("segment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), ("nation", F.col("c_nationkey") < 20)]
    return S.validated(table(spark, sf, "customer"), rules).select(F.col("c_custkey").alias("id"), "reasons", "ok")


@R.query("SELECT 'customer' AS store, c_custkey AS id, c_name AS name, '' AS reasons, true AS ok FROM customer UNION ALL SELECT 'broken', NULL, NULL, 'json,id', false")
def backup_round_trip(spark, sf):
    """Customers dumped to JSON and read back with a broken row."""
    dump = S.to_backup(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "customer")
    broken = spark.createDataFrame([("broken", "{oops")], dump.schema)
    return S.from_backup(dump.unionByName(broken), "id bigint, name string", [("id", F.col("id").isNotNull())]).select("store", "id", "name", "reasons", "ok")


@R.query("SELECT p_partkey, p_name, suppressed FROM (SELECT *, bool_and(hit) OVER () AS suppressed FROM (SELECT p_partkey, p_name, contains(lower(p_name), 'widget') OR contains(lower(p_name), 'ring') AS hit FROM part)) WHERE NOT hit OR suppressed")
def exclude_terms(spark, sf):
    return D.exclude_unless_empty(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("p_name"), ["widget", "ring"])


@R.query("SELECT p_partkey, true AS suppressed FROM part")
def exclude_terms_suppressed(spark, sf):
    """Terms that hit every row: the filter stands back."""
    return D.exclude_unless_empty(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("p_name"), ["a", "e", "i", "o", "u"]).select("p_partkey", "suppressed")


@R.query(f"""SELECT id, place, {', '.join(f"floor({k} * 1000000 + 0.5) / 1000000 AS {k}" for k in ('overall', 'fitness', 'compensation', 'location', 'seniority'))} FROM (SELECT *, CAST(row_number() OVER (ORDER BY floor(overall * 1000000 + 0.5) DESC, id) AS INTEGER) AS place FROM (
  SELECT p_partkey AS id, 5.0 * (0.45 * fit + coalesce(0.35 * pay, 0) + 0.1 * loc + coalesce(0.1 * sen, 0)) / (0.45 + CASE WHEN pay IS NULL THEN 0 ELSE 0.35 END + 0.1 + CASE WHEN sen IS NULL THEN 0 ELSE 0.1 END) AS overall, 5.0 * fit AS fitness, 5.0 * pay AS compensation, 5.0 * loc AS location, 5.0 * sen AS seniority FROM (
  SELECT p_partkey, b / (b + 9.0) AS fit, 0.5 + 0.5 * (y / (y + 180000.0)) AS pay, CASE WHEN p_type = 'SMALL' THEN 1.0 ELSE 0.5 END AS loc, CASE WHEN p_size < 10 THEN greatest(0.0, 1.0 - abs(p_size) * 0.2) END AS sen FROM (
  SELECT *, p_size * (p_size / (p_size + 10.0)) AS b, CASE WHEN p_retailprice * 12 >= 10000 THEN p_retailprice * 12 END AS y FROM part)))) WHERE place <= 500""")
def rank_rating(spark, sf):
    """Parts rated as postings; the best 500 of all. Size stands for coverage and for the distance of levels, the price for monthly pay."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    base = F.col("p_size") * (F.col("p_size") / (F.col("p_size") + V.TERMS_HALF))
    stars = M.rating(base, M.annual_pay(F.col("p_retailprice"), F.lit("month")), None, F.col("p_type") == "SMALL", F.when(F.col("p_size") < 10, F.col("p_size")))
    rated = p.select(F.col("p_partkey").alias("id"), *[(F.floor(v * 1000000 + 0.5) / 1000000).alias(k) for k, v in stars.items()])
    top = rated.orderBy(F.desc("overall"), "id").limit(500)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("overall"), "id")))


@R.query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def newest_choices(spark, sf):
    return K.newest(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20)


_PRED = f"SELECT doc_id, tier <> 'low' AS p FROM ({sql.pool('doc_id', sql.features())})"


@R.query(f"""SELECT CASE WHEN g = 1 THEN 'ALL' ELSE coalesce(lang, 'none') END AS grp, matched, predicted, expected, n, CASE WHEN predicted > 0 THEN matched / predicted END AS precision, CASE WHEN expected > 0 THEN matched / expected END AS recall FROM (
  SELECT lang, grouping(lang) AS g, count(*) FILTER (p AND a) AS matched, count(*) FILTER (p) AS predicted, count(*) FILTER (a) AS expected, count(*) AS n FROM (SELECT lang, coalesce(p, false) AS p, quality = 1 AS a FROM labels JOIN documents USING (doc_id) LEFT JOIN ({_PRED}) USING (doc_id)) GROUP BY ROLLUP (lang))""")
def confusion_precision_recall(spark, sf):
    """Bands of the flagship query against the quality labels, by language and over all."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    labels = table(spark, sf, "labels")
    judged = d.select("doc_id", "text").join(labels, "doc_id", "left_semi")  # only labelled texts are scored
    pred = B.pool_scores(B.features(B.bullets(judged)), "doc_id").select("doc_id", (F.col("tier") != "low").alias("p"))
    rows = labels.join(d.drop("text"), "doc_id").join(pred, "doc_id", "left")
    return Q.confusion(rows, F.coalesce("p", F.lit(False)), F.col("quality") == 1, "lang")


@R.query("""SELECT source, n, toxic_rate, good_rate, clean_when_good, (coalesce(toxic_rate, 0) + coalesce(good_rate, 0) + coalesce(clean_when_good, 0)) / (CAST(toxic_rate IS NOT NULL AS INT) + CAST(good_rate IS NOT NULL AS INT) + CAST(clean_when_good IS NOT NULL AS INT)) AS aggregate FROM (
  SELECT source, count(*) AS n, avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) AS toxic_rate, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS good_rate, avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END) FILTER (quality = 1) AS clean_when_good FROM labels JOIN documents USING (doc_id) GROUP BY source)""")
def eval_rates(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return Q.rates(rows, ["source"], {"toxic_rate": toxic, "good_rate": good, "clean_when_good": ~toxic}, {"clean_when_good": good})


@R.query("SELECT user_id, runs, cold, failure_rate, CASE WHEN runs > 1 THEN (s - cold) / (runs - 1) END AS warm FROM (SELECT user_id, count(*) AS runs, min_by(value, event_id) AS cold, sum(value) AS s, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS failure_rate FROM events GROUP BY user_id)")
def cold_warm_latency(spark, sf):
    return Q.cold_and_warm(table(spark, sf, "events"), "user_id", F.col("event_id"), "value", F.col("event_type") == "error")


@R.query("SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY ALL")
def issue_pivot(spark, sf):
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_type")
    return e.groupBy("day").pivot("event_type", ["click", "error", "view"]).agg(F.count("event_type")).na.fill(0, ["click", "error", "view"])


@R.query("SELECT user_id, CAST(bit_or(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 4 WHEN 'purchase' THEN 8 WHEN 'error' THEN 16 ELSE 0 END) AS INTEGER) AS mask FROM events GROUP BY user_id")
def tier_mask(spark, sf):
    """The kinds of events a user has, one bit for each."""
    bits = {"signup": 1, "view": 2, "click": 4, "purchase": 8, "error": 16}
    bit = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in bits.items()], F.lit(0))
    return table(spark, sf, "events").groupBy("user_id").agg(F.bit_or(bit).alias("mask"))


@R.query("""WITH w AS (SELECT coalesce(lang, 'none') AS lang, unnest(list_distinct(list_filter(string_split(""" + sql.flat("text") + """, ' '), lambda t: length(t) >= 2))) AS term FROM documents),
  c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS place, lead(n) OVER (PARTITION BY lang ORDER BY n DESC, term) AS next FROM c)
  SELECT lang, term, r.n AS n, CAST(place AS INTEGER) AS place, floor(r.n / d.docs * 1000 + 0.5) / 1000 AS share, coalesce(r.n - next > sqrt(r.n + next), false) AS ahead FROM r JOIN (SELECT coalesce(lang, 'none') AS lang, count(*) AS docs FROM documents GROUP BY ALL) d USING (lang) WHERE place <= 10""")
def prevalence_mine(spark, sf):
    """The ten terms of most documents in each language, their share, and whether each leads the next by more than noise."""
    d = table(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), "text")
    counts = d.select("lang", F.explode(X.token_set(F.col("text"), 2)).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    top = counts.withColumn("place", F.row_number().over(by)).where("place <= 11").withColumn("next", F.lead("n").over(by)).where("place <= 10")
    size = d.groupBy("lang").agg(F.count("*").alias("docs"))
    lead = F.coalesce(F.col("n") - F.col("next") > F.sqrt(F.col("n") + F.col("next")), F.lit(False))
    return top.join(size, "lang").select("lang", "term", "n", "place", (F.floor(F.col("n") / F.col("docs") * 1000 + 0.5) / 1000).alias("share"), lead.alias("ahead"))


@R.query("SELECT n_nationkey AS id, (CAST(s.n IS NOT NULL AS INT) + CAST(c.n IS NOT NULL AS INT) + CAST(coalesce(c.n, 0) >= 3 AS INT)) / 3 AS ratio, array_to_string(list_filter([CASE WHEN s.n IS NULL THEN 'supplier' END, CASE WHEN c.n IS NULL THEN 'customer' END, CASE WHEN coalesce(c.n, 0) < 3 THEN 'three customers' END], lambda x: x IS NOT NULL), ',') AS missing FROM nation LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL) s ON s.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL) c ON c.k = n_nationkey")
def completeness_ratio(spark, sf):
    """Share of a checklist that each nation meets, and what is missing."""
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("ns"))
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("nc"))
    checks = [("supplier", F.col("ns").isNotNull()), ("customer", F.col("nc").isNotNull()), ("three customers", F.coalesce("nc", F.lit(0)) >= 3)]
    met = sum((c.cast("int") for _, c in checks[1:]), checks[0][1].cast("int"))
    missing = F.array_join(F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks])), ",")
    return table(spark, sf, "nation").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").select(F.col("n_nationkey").alias("id"), (met / len(checks)).alias("ratio"), missing.alias("missing"))


_FUNNEL = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL"


@R.query(_FUNNEL)
def event_funnel(spark, sf):
    return E.funnel(table(spark, sf, "events"))


@R.query(_FUNNEL)
def event_funnel_stream(spark, sf):
    """The same counts, computed by a stream over the events' files."""
    from uuid import uuid4

    from sedgework.sources.tables import stream

    path = f"{shared_dir(spark)}/funnel-{uuid4().hex}"
    E.write_all(E.funnel(stream(spark, sf, "events")), f"{path}/out", f"{path}/checkpoint", "complete").awaitTermination()
    return spark.read.parquet(f"{path}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; a temporary one only where it is unset in local mode."""
    from tempfile import mkdtemp

    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", mkdtemp(prefix="sedgework-"))
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


@R.query("""SELECT start, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start""")
def sliding_windows(spark, sf):
    """Events of each two hours, every hour."""
    return E.sliding(table(spark, sf, "events")).select("start", "n")


@R.query("""WITH g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
  SELECT user_id, min(ts) AS start, count(*) AS n, max_by(event_id, {'t': ts, 'e': event_id}) AS event_id, max_by(event_type, {'t': ts, 'e': event_id}) AS event_type, max_by(value, {'t': ts, 'e': event_id}) AS value FROM g GROUP BY user_id, s""")
def debounce_sessions(spark, sf):
    return E.settled(table(spark, sf, "events"))


@R.query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events) GROUP BY ALL")
def events_once_a_day(spark, sf):
    """Days on which a user had an event of a kind."""
    e = table(spark, sf, "events").withColumn("day", F.date_trunc("day", "ts"))
    return E.once(e, ["user_id", "event_type", "day"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@R.query()
def group_lines(spark, sf):
    """Line items as the items of a page: the order is the page, quantity and tax the place."""
    items = table(spark, sf, "lineitem").select(F.lit(1).alias("doc_id"), F.col("l_orderkey").alias("page"), (F.col("l_tax") * 1000).alias("x"), F.col("l_quantity").cast("double").alias("y"), F.col("l_shipdate").cast("string").alias("str"))
    return Q.rows_of_items(items)


@R.query("SELECT r_name AS region, n_name AS nation, grouping(r_name) + grouping(n_name) AS level, count(*) AS n, floor(avg(c_acctbal) * 100 + 0.5) / 100 AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)".replace("grouping(r_name) + grouping(n_name) AS level", "CAST(grouping(r_name) + grouping(n_name) AS INTEGER) AS level"))
def truth_rollup(spark, sf):
    """Counts and mean balances of nations, regions and all."""
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = j.withColumnsRenamed({"r_name": "region", "n_name": "nation"}).rollup("region", "nation")
    return g.agg((F.grouping("region") + F.grouping("nation")).cast("int").alias("level"), F.count("*").alias("n"), (F.floor(F.avg("c_acctbal") * 100 + 0.5) / 100).alias("balance"))
