"""Queries over nearest records, values found again in lines, and contact data."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from sedgework.operators import bullets as B
from sedgework.operators import contacts as C
from sedgework.operators import nearest as N
from sedgework.plans import sql
from sedgework.plans.registry import Registry
from sedgework.sources.tables import table

R = Registry()

AXES, LEAST = {"p_name": 3, "p_brand": 2, "p_type": 1, "p_size": 1}, 3
_SETS = [s for n in range(1, len(AXES) + 1) for s in combinations(AXES, n) if sum(AXES[a] for a in s) >= LEAST]
_SAME = {a: f"coalesce(a.{a} = b.{a}, false)" for a in AXES}
_WEIGHT = " + ".join(f"CASE WHEN {_SAME[a]} THEN {w} ELSE 0 END" for a, w in AXES.items())
_INDEX = "CASE " + " ".join(f"WHEN {' AND '.join(_SAME[a] if a in s else f'NOT {_SAME[a]}' for a in AXES)} THEN {i}" for i, s in enumerate(_SETS)) + " END"
_AGREED = "CASE k " + " ".join(f"WHEN {i} THEN {sql.q(','.join(s))}" for i, s in enumerate(_SETS)) + " END"


@R.query(f"""SELECT id, nearest, CAST(weight AS INTEGER) AS weight, {_AGREED} AS agreed FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, k, nearest) AS place FROM (
  SELECT a.p_partkey AS id, b.p_partkey AS nearest, {_WEIGHT} AS weight, {_INDEX} AS k FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND a.p_partkey % 3 = 0) WHERE weight >= {LEAST}) WHERE place = 1""")
def nearest_records(spark, sf):
    """For every third part the part that it agrees with most by name, brand, type and size, among all others."""
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "id")
    found = N.nearest_records(p.where("id % 3 = 0"), p, AXES, LEAST)
    return found.select("id", "nearest", "weight", F.array_join("agreed", ",").alias("agreed"))


#: Only ASCII: the other engine's distance counts bytes.
_FOLD = "trim(regexp_replace(lower(regexp_replace({0}, '[^ -~]', 'x', 'g')), '\\s+', ' ', 'g'))"
_VALUE = "array_to_string(string_split(" + _FOLD.format("line") + ", ' ')[1:3], ' ')"


@R.query(f"""WITH l AS (SELECT doc_id, ord, {_FOLD.format('line')} AS t FROM ({sql.lines()})), v AS (SELECT doc_id, left(x, 1) || 'q' || x[3:] AS v FROM (SELECT doc_id, {_VALUE} AS x FROM ({sql.lines()}) WHERE ord = 0) WHERE length(x) > 2),
  w AS (SELECT doc_id, v, ord, i AS place_, array_to_string(p[i + 1:i + n], ' ') AS said FROM (SELECT doc_id, v, ord, p, n, unnest(generate_series(0, greatest(len(p) - n, 0))) AS i FROM (SELECT doc_id, v, ord, string_split(t, ' ') AS p, len(string_split(v, ' ')) AS n FROM l JOIN v USING (doc_id) WHERE t <> ''))),
  d AS (SELECT *, levenshtein(v, said) AS distance FROM w)
  SELECT doc_id, v AS value, CAST(ord AS INTEGER) AS ord, CAST(place_ AS INTEGER) AS "at", said, CAST(distance AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, ord, place_) AS place FROM d WHERE distance <= 2) WHERE place = 1""")
def localized_values(spark, sf):
    """The first words of every document, with an error in them, found again in its lines."""
    lines = B.lines(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ord", F.regexp_replace("line", "[^ -~]", "x").alias("text"))
    first = F.array_join(F.slice(F.split(N.folded(F.col("text")), " "), 1, 3), " ")
    v = lines.where("ord = 0").select("doc_id", first.alias("x")).where(F.length("x") > 2)
    v = v.select("doc_id", F.lit("first").alias("field"), F.concat(F.substring("x", 1, 1), F.lit("q"), F.expr("substring(x, 3)")).alias("value"))
    return N.localized(v, lines, "doc_id").drop("field")


_N = "c_custkey"


@R.query(f"""SELECT {_N}, CASE WHEN {_N} % 4 < 3 THEN 'me' || {_N} || '@mail.org' END AS email, CASE WHEN {_N} % 3 = 0 THEN '(555) 123-' || (1000 + {_N} % 9000) END AS phone, CASE WHEN {_N} % 5 = 0 THEN 'linkedin.com/in/me-' || {_N} END AS linkedin,
  CASE WHEN {_N} % 2 = 0 THEN 'https://me' || {_N} || '.dev' ELSE '' END AS links, CASE WHEN {_N} % 6 = 1 THEN 'Austin, TX' WHEN {_N} % 6 = 2 THEN 'Berlin, Germany' END AS location FROM customer""")
def contact_data(spark, sf):
    """E-mail, phone, profiles, links and place in the lines made of every customer."""
    n = F.col(_N)
    cell = lambda c, x: F.when(c, x)
    top = F.concat_ws(" | ", cell(n % 4 < 3, F.concat(F.lit("me"), n, F.lit("@mail.org"))), cell(n % 3 == 0, F.concat(F.lit("(555) 123-"), 1000 + n % 9000)), F.when(n % 6 == 1, "Austin, TX").when(n % 6 == 2, "Berlin, Germany"), F.lit("Engineer"))
    second = F.concat_ws(" · ", cell(n % 5 == 0, F.concat(F.lit("linkedin.com/in/me-"), n)), cell(n % 2 == 0, F.concat(F.lit("https://me"), n, F.lit(".dev"))), F.lit("writes of acme.biz in words"))
    lines = table(spark, sf, "customer").select(n, F.posexplode(F.array("c_name", top, second)).alias("ord", "text"))
    found = C.contacts(lines, [_N])
    return found.select(_N, "email", "phone", "linkedin", F.array_join("links", " ").alias("links"), "location")
