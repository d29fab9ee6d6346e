"""Queries over what a search is built from; parts, orders and suppliers make the records."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgework.functions import values as V
from sedgework.operators import wishes as W
from sedgework.plans import sql
from sedgework.plans.parse_queries import view
from sedgework.plans.registry import Registry
from sedgework.plans.shape_queries import _title, _words
from sedgework.sources.tables import dealt_out, table

R = Registry()
HEADLINE = "CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' engineer · ', p_brand, ' | Lead ', p_type) WHEN 1 THEN concat(p_type, ' – ', p_name, ' developer') WHEN 2 THEN concat('  ', p_name, ' ') WHEN 3 THEN concat(p_type, ' / ', p_brand) WHEN 4 THEN '' ELSE concat(p_name, '-', p_type) END"
_PARTS = "list_filter(list_transform(string_split_regex(trim({0}), '[·•|]|\\s[-–—/]\\s'), lambda p: trim(p)), lambda p: p <> '')"
_P = _PARTS.format("h")
_SPLIT = f"CASE WHEN len({_P}) <= 1 THEN {_P} WHEN len(list_filter({_P}, lambda t: {_title('t')})) > 0 THEN list_filter({_P}, lambda t: {_title('t')}) ELSE [trim(h)] END"
_ROWS = f"SELECT p_partkey, p_name, p_brand, p_type, p_size, {HEADLINE} AS h FROM part "
_OTHERS = ("upper(concat(p_name, ' engineer'))", "p_name", "concat(' ', p_type)", "p_brand", "lower(p_brand)", "'last'")


@R.query(f"""SELECT p_partkey, array_to_string({_SPLIT}, ';') AS parts, CASE WHEN len({_P}) > 1 THEN coalesce(list_filter({_P}, lambda t: {_title('t')})[1], trim(h)) ELSE trim(h) END AS head,
  array_to_string(list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i)[1:{V.MOST_TITLES}], ';') AS titles
  FROM (SELECT *, list_filter(list_transform(list_concat({_SPLIT}, [{', '.join(_OTHERS)}]), lambda x: trim(x)), lambda x: x <> '') AS t FROM ({_ROWS}))""")
def wanted_titles(spark, sf):
    """Headlines in parts, the head of each, and the titles that a search begins with."""
    rows = view(spark, sf, f"SELECT p_partkey, {HEADLINE} AS h, array({', '.join(_OTHERS)}) AS others FROM part ", "part")
    h = F.col("h")
    return rows.select("p_partkey", F.array_join(W.split_headline(h), ";").alias("parts"), W.role_head(h).alias("head"), F.array_join(W.wanted_titles(h, F.col("others")), ";").alias("titles"))


LABELS = {"red widget": "Red Widget (TM)", "widget": "Widget", "rw": "Red Widget (TM)", "promo": "Promotion"}
_LISTED = "array(p_name, concat(' ', p_type, ' '), 'RW', '', p_name, lower(p_type), 'own skill', p_brand)"
_LABEL = "CASE lower({0}) " + " ".join(f"WHEN {sql.q(k)} THEN {sql.q(v)}" for k, v in LABELS.items()) + " END"
_CAPITAL = "array_to_string(list_transform(string_split_regex({0}, '\\s+'), lambda w: upper(w[1]) || w[2:]), ' ')"


@R.query(f"""SELECT p_partkey, array_to_string(list_concat(list_transform(list_filter(e, lambda s: {_LABEL.format('s')} IS NOT NULL), lambda s: {_LABEL.format('s')}), list_transform(list_filter(e, lambda s: {_LABEL.format('s')} IS NULL), lambda s: {_CAPITAL.format('s')}))[1:{V.MOST_SKILLS}], ';') AS skills
  FROM (SELECT p_partkey, list_filter(c, lambda s, i: list_position(list_transform(c, lambda y: coalesce({_LABEL.format('y')}, lower(y))), coalesce({_LABEL.format('s')}, lower(s))) = i) AS e FROM (
  SELECT p_partkey, list_filter(list_transform([p_name, ' ' || p_type || ' ', 'RW', '', p_name, lower(p_type), 'own skill', p_brand], lambda s: trim(s)), lambda s: s <> '') AS c FROM part))""")
def wanted_skills(spark, sf):
    """The skills that a search begins with: the dictionary's first, under their labels."""
    return view(spark, sf, f"SELECT p_partkey, {_LISTED} AS s FROM part ", "part").select("p_partkey", F.array_join(W.wanted_skills(F.col("s"), LABELS), ";").alias("skills"))


VOCABULARY = ["widget", "bolt"]


@R.query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x NOT IN ('widget', 'bolt')))), ';') AS noise FROM (SELECT p_partkey, list_concat(list_concat({_words('p_type')}, {_words('p_name')}), {_words(chr(39) + 'Acme, the Widget-works' + chr(39))}) AS w FROM part)")
def title_noise(spark, sf):
    """Words of places and employers that would only disturb a search by title."""
    from sedgework.sources.tables import table

    noise = W.title_noise(F.array("p_type"), F.array("p_name", F.lit("Acme, the Widget-works")), VOCABULARY)
    # within a field the order is free
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(noise), ";").alias("noise"))


_EXPECTED = "CASE p_partkey % 4 WHEN 0 THEN 'Team of Widget' WHEN 1 THEN 'red widget' WHEN 2 THEN 'bolt' ELSE 'the' END"
_SKILL = "concat(p_name, CASE p_size % 3 WHEN 0 THEN ' & team' WHEN 1 THEN '/Team Widget' ELSE ' and Bolts' END)"
_SW = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN (" + ", ".join(map(sql.q, V.SKILL_STOPS)) + "))"


@R.query(f"""SELECT p_partkey, len(e) > 0 AND list_bool_or(list_transform(c, lambda x: len(x) > 0 AND list_has_all(x, e))) AS covers, len(e) > 0 AND (list_bool_or(list_transform(c, lambda x: len(x) > 0 AND list_has_all(x, e))) OR (len(e) > 1 AND list_bool_or(list_transform(c, lambda x: list_contains(x, e[-1]) AND list_has_all(e, x))))) AS covers_loosely
  FROM (SELECT p_partkey, {_SW.format('e')} AS e, list_transform(string_split_regex(s, '(?i)\\s*(?:&|/|,|\\band\\b)\\s*'), lambda y: {_SW.format('y')}) AS c FROM (SELECT p_partkey, {_EXPECTED} AS e, {_SKILL} AS s FROM part))""")
def skill_cover(spark, sf):
    """Whether what a record says covers an expected skill, in full or by its head."""
    rows = view(spark, sf, f"SELECT p_partkey, {_EXPECTED} AS e, {_SKILL} AS s FROM part ", "part")
    e, s = F.col("e"), F.col("s")
    return rows.select("p_partkey", W.skill_covers(e, s).alias("covers"), W.skill_covers(e, s, less=True).alias("covers_loosely"))


_LINKS = ("concat('https://www.linkedin.com/in/u', s_suppkey % 7, '/')", "concat('linkedin.com/company/c', s_suppkey)", "concat('github.com/u', s_suppkey % 3, '.')", "concat('HTTPS://GitHub.com/U', s_suppkey % 3)", "''", "'localhost'", "'word'", "concat('scholar.google.de/x', s_suppkey)", "concat('https://me', s_suppkey, '.example.org')")


def _profile(u: str) -> str:
    full = f"regexp_replace(regexp_replace(trim({u}), '[,;.)/]+$', ''), '(?i)^(https?://)?www[.]', '\\1')"
    return f"CASE WHEN regexp_matches({full}, '(?i)^[a-z][a-z0-9+.-]*://') THEN {full} ELSE 'https://' || {full} END"


_HOST = "regexp_extract({0}, '(?i)^[a-z]+://([^/?#:]*)', 1)"
_NETWORK = "CASE " + " ".join(f"WHEN regexp_matches(h, {sql.q(p)})" + (f" AND NOT {sql.has('u', V.LINKEDIN_OTHER)}" if n == "LinkedIn" else "") + f" THEN {sql.q(n + ':' + k)}" for p, n, k in V.PROFILE_HOSTS) + " ELSE h || ':other' END"


@R.query(f"""SELECT s_suppkey, string_agg(u || ' ' || network, ';' ORDER BY i) AS profiles FROM (SELECT s_suppkey, i, u, {_NETWORK} AS network, row_number() OVER (PARTITION BY s_suppkey, regexp_replace(lower(u), '^[a-z]+://(www[.])?', '') ORDER BY i) AS nth FROM (
  SELECT s_suppkey, i, u, lower({_HOST.format('u')}) AS h FROM (SELECT s_suppkey, i, {_profile('l')} AS u FROM (SELECT s_suppkey, unnest([{', '.join(_LINKS)}]) AS l, unnest(generate_series(1, {len(_LINKS)})) AS i FROM supplier) WHERE trim(l) <> '')) WHERE contains(h, '.') OR h = 'localhost') WHERE nth = 1 GROUP BY s_suppkey""")
def web_profiles(spark, sf):
    """The profiles of a record: network and kind by host, each address once."""
    links = lambda own: F.array(*map(F.expr, own))
    rows = dealt_out(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", links(_LINKS[:3]).alias("old"), links(_LINKS[3:]).alias("more"))
    shown = F.transform(W.contact_profiles(F.col("old"), F.col("more")), lambda p: F.concat(p["url"], F.lit(" "), p["network"], F.lit(":"), p["kind"]))
    return rows.select("s_suppkey", F.array_join(shown, ";").alias("profiles"))
