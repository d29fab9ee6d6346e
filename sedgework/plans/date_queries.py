"""Queries over dates in lines: each order makes one line of one of sixteen shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.functions import dates as T
from sedgework.functions import values as V
from sedgework.operators import checks as K
from sedgework.plans import sql
from sedgework.plans.registry import Registry
from sedgework.sources.tables import table

R = Registry()
AS_OF = "1999-08-02 12:34:56"
#: Shapes of a line by the order's key; a and b are months with years, y and z years, n and m numeric months, t a text.
SHAPES = """CASE k WHEN 0 THEN t || ', ' || a || ' – ' || b WHEN 1 THEN a || ' - Present' WHEN 2 THEN y || ' - ' || z WHEN 3 THEN n || ' to ' || m
 WHEN 4 THEN 'Summer ' || y || ', ' || z WHEN 5 THEN 'Expected Graduation: ' || a WHEN 6 THEN z WHEN 7 THEN 'Head of Marketing ' || y
 WHEN 8 THEN 'Month Year - Month Year' WHEN 9 THEN 'Award; (' || y || ')' WHEN 10 THEN t || ' | ' || a WHEN 11 THEN 'Fall ' || y || ' – Spring ' || z
 WHEN 12 THEN '5000 - 6000' WHEN 13 THEN a || '  ' || b WHEN 14 THEN 'Led the work on a platform. The team grew and shipped it in ' || y ELSE 'Minor in Economics · ' || n END"""
_ORDERS = f"""SELECT o_orderkey, o_custkey, o_orderdate, a, b, y, z, n, m, k, {SHAPES} AS line FROM (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority AS t, strftime(o_orderdate, '%b %Y') AS a, strftime(later, '%b. %Y') AS b,
  strftime(o_orderdate, '%Y') AS y, strftime(later, '%Y') AS z, strftime(o_orderdate, '%m/%Y') AS n, strftime(later, '%m/%Y') AS m, o_orderkey % 16 AS k
  FROM (SELECT *, o_orderdate + to_days(CAST(o_custkey * 7 % 900 AS INTEGER)) AS later FROM orders))"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("later", F.expr("o_orderdate + make_dt_interval(cast(o_custkey * 7 % 900 AS int))"))
    form = lambda c, p: F.date_format(c, p)
    parts = {"a": form("o_orderdate", "MMM yyyy"), "b": form("later", "MMM. yyyy"), "y": form("o_orderdate", "yyyy"), "z": form("later", "yyyy"), "n": form("o_orderdate", "MM/yyyy"), "m": form("later", "MM/yyyy"), "t": F.col("o_orderpriority"), "k": F.col("o_orderkey") % 16}
    return o.withColumns(parts).withColumn("line", F.expr(SHAPES))


def _x(s: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({s}, {sql.q(pattern)}, {group})"


def _some(s: str) -> str:
    return f"nullif(trim({s}), '')"


def _spaced(s: str) -> str:
    return f"trim({sql.swap(s, chr(92) + 's+', ' ')})"


def _first(s: str, pattern: str) -> str:
    return f"nullif({_x(s, pattern)}, '')"


def _before(s: str, pattern: str) -> str:
    return f"CASE WHEN {sql.has(s, pattern)} THEN {_x(s, f'(?is)^(.*?)(?:' + pattern.removeprefix('(?i)') + ')', 1)} END"


def _lone(s: str) -> str:
    month = "(?i)" + V.STRICT_MONTH_YEAR
    a, b = f"length({_before(s, month)})", f"length({_before(s, V.BARE_YEAR)})"
    return f"CASE WHEN {a} IS NOT NULL AND ({b} IS NULL OR {a} <= {b}) THEN {_spaced(_first(s, month))} ELSE {_first(s, V.BARE_YEAR)} END"


def _ranges(rows: str, line: str = "line") -> str:
    """Rows with start, end and current of each line."""
    g = lambda k: _x(line, V.DATE_RANGE, k)
    return f"""SELECT *, CASE WHEN NOT ranged THEN lone WHEN s5 <> '' THEN s5 WHEN {sql.has('s', V.PLACEHOLDER_DATE)} THEN NULL ELSE s END AS start,
      CASE WHEN NOT ranged THEN NULL WHEN s5 <> '' THEN s6 WHEN {sql.has('s', V.PLACEHOLDER_DATE)} OR {sql.has('e', '(?i)^(' + V.OPEN_END + ')$')} OR {sql.has('e', V.PLACEHOLDER_DATE)} THEN NULL ELSE e END AS "end",
      ranged AND s5 = '' AND NOT {sql.has('s', V.PLACEHOLDER_DATE)} AND {sql.has('e', '(?i)^(' + V.OPEN_END + ')$')} AS current
      FROM (SELECT *, {sql.has(line, V.DATE_RANGE)} AS ranged, {_spaced(f"CASE WHEN {g(1)} <> '' THEN {g(1)} ELSE {g(3)} END")} AS s, {_spaced(f"CASE WHEN {g(2)} <> '' THEN {g(2)} ELSE {g(4)} END")} AS e, {_spaced(g(5))} AS s5, {_spaced(g(6))} AS s6, {_lone(line)} AS lone FROM ({rows}))"""


def _year(s: str) -> str:
    return _first(s, V.BARE_YEAR)


def _precision(s: str) -> str:
    return f"CASE WHEN {sql.has(s, '(?i)' + chr(92) + 'b' + V.LOOSE_MONTH + chr(92) + 'b')} OR {sql.has(s, V.NUMERIC_MONTH_YEAR)} THEN 'month' WHEN {s} IS NOT NULL THEN 'year' END"


@R.query(f'SELECT o_orderkey, line, start, "end", current FROM ({_ranges(_ORDERS)})')
def date_ranges(spark, sf):
    return lines(spark, sf).select("o_orderkey", "line", T.date_range(F.col("line")).alias("r")).select("o_orderkey", "line", "r.*")


def _strip(s: str) -> str:
    out = f"trim(regexp_replace({s}, {sql.q('(?is)^(.*?)(?:' + V.DATE_RANGE.removeprefix('(?i)') + ')(.*)$')}, '\\1\\8'))"
    for p in (f"(?i)\\b(?:{V.OPEN_END})\\b", f"(?i){V.STRICT_MONTH_YEAR}", V.BARE_YEAR, "\\[\\s*\\]|[(]\\s*[)]"):
        out = f"trim({sql.swap(out, p)})"
    return sql.swap(out, f"^[\\s{V.TRIMMED_SEPARATORS}]+|[\\s{V.TRIMMED_SEPARATORS}]+$")


_REGION = f"(?i){V.LOOSE_MONTH_YEAR}|{V.NUMERIC_MONTH_YEAR}|{V.BARE_YEAR}"


@R.query(f"SELECT o_orderkey, {_strip('line')} AS rest, nullif({_x('(' + _before('line', _REGION) + ')', f'([{V.REPORTED_SEPARATOR}])' + chr(92) + 's*$', 1)}, '') AS separator FROM ({_ORDERS})")
def date_strip(spark, sf):
    """A line without its dates, and the mark that set them off."""
    line = F.col("line")
    return lines(spark, sf).select("o_orderkey", T.without_dates(line).alias("rest"), T.date_separator(line).alias("separator"))


def _lone_range(s: str, single: bool) -> str:
    whole = f"{_x(f'trim({s})', V.DATE_RANGE)} = trim({s})" + (f" OR {sql.has(f'trim({s})', '^(?:19|20)[0-9]{2}$')}" if single else "")
    return f"(trim({s}) <> '' AND NOT {sql.has(f'trim({s})', '(?i)^' + V.SEASON + chr(92) + 'b')} AND {sql.has(f'trim({s})', '(?:19|20)[0-9]{2}|[A-Za-z' + chr(39) + '/]')} AND ({whole}))"


def _date_only(s: str) -> str:
    for p in V.DATE_WORDS:
        s = sql.swap(s, p)
    return f"(trim({s}) = '')"


def prose(s: str) -> str:
    return f"({sql.has(f'trim({s})', '[a-z]')} AND {sql.has(f'trim({s})', V.SENTENCE_BREAK)} AND len({sql.tokens(f'trim({s})')}) >= {V.PROSE_WORDS})"


def entry_header(s: str) -> str:
    return f"(trim({s}) <> '' AND {sql.has(f'trim({s})', '^[A-Z0-9]')} AND NOT {_date_only(f'trim({s})')} AND NOT {prose(s)} AND NOT {sql.has(f'trim({s})', V.PROGRAM_NOTE)})"


@R.query(f"SELECT o_orderkey, {_lone_range('line', False)} AS lone_range, {_lone_range('line', True)} AS lone_or_year, {_date_only('line')} AS date_only, {prose('line')} AS prose, {entry_header('line')} AS entry_header FROM ({_ORDERS})")
def date_line_shapes(spark, sf):
    """What a line with dates is: a range alone, dates alone, prose, the head of an entry."""
    from sedgework.functions import shapes as H

    line = F.col("line")
    return lines(spark, sf).select(
        "o_orderkey", T.is_lone_range(line).alias("lone_range"), T.is_lone_range(line, single=True).alias("lone_or_year"),
        T.is_date_only(line).alias("date_only"), H.is_prose(line).alias("prose"), H.is_entry_header(line).alias("entry_header"),
    )


_RICH = f"coalesce({_spaced('replace(' + _first('line', '(?i)' + V.LOOSE_MONTH_YEAR) + ', ' + sql.q('.') + ', ' + sql.q('') + ')')}, {_first('line', V.NUMERIC_MONTH_YEAR)}, {_year('line')}, \"end\", start)"


@R.query(f"""SELECT o_orderkey, s AS start, e AS "end", c AS current, year, {_precision('s')} AS start_precision, {_precision('e')} AS end_precision FROM (
  SELECT o_orderkey, CASE WHEN both_ THEN start END AS s, CASE WHEN both_ THEN "end" ELSE rich END AS e, both_ AND current AS c, CASE WHEN both_ THEN coalesce({_year('"end"')}, {_year('start')}) ELSE {_year('rich')} END AS year
  FROM (SELECT *, start IS NOT NULL AND (current OR "end" IS NOT NULL) AS both_, {_RICH} AS rich FROM ({_ranges(_ORDERS)})))""")
def education_dates(spark, sf):
    return lines(spark, sf).select("o_orderkey", T.education_dates(F.col("line")).alias("r")).select("o_orderkey", "r.*")


_FIELDS = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN a END AS s, CASE WHEN o_orderkey % 3 <> 0 THEN ' ' || b || ' ' ELSE '' END AS e, o_orderkey % 4 = 0 AS c FROM ({})"


@R.query(f"""SELECT o_orderkey, coalesce(s, e) AS start, CASE WHEN s IS NOT NULL THEN e END AS "end", s IS NOT NULL AND e IS NULL AND c AS current,
  concat_ws(' – ', s, CASE WHEN c THEN 'Present' ELSE e END) AS shown, concat_ws('–', s, CASE WHEN c THEN 'Present' ELSE e END) AS compact,
  CASE WHEN regexp_matches(e, '^[A-Za-z]{{3,9}}[.]?\\s+[0-9]{{4}}$') THEN regexp_extract(e, '^([A-Za-z]+)', 1) || ' 1, ' || right(e, 4) ELSE e END AS parseable
  FROM (SELECT o_orderkey, {_some('s')} AS s, {_some('e')} AS e, c FROM ({_FIELDS.format(_ORDERS)}))""")
def entry_dates(spark, sf):
    """An entry's dates by the editor's rule, and as they are shown."""
    f = lines(spark, sf).selectExpr("o_orderkey", "CASE WHEN o_orderkey % 5 <> 0 THEN a END AS s", "CASE WHEN o_orderkey % 3 <> 0 THEN ' ' || b || ' ' ELSE '' END AS e", "o_orderkey % 4 = 0 AS c")
    s, e, c = F.col("s"), F.col("e"), F.col("c")
    out = f.select("o_orderkey", T.settled_dates(s, e, c).alias("r"), T.shown_range(s, e, c).alias("shown"), T.shown_range(s, e, c, "\u2013").alias("compact"), T.parseable(T.some(e)).alias("parseable"))
    return out.select("o_orderkey", "r.*", "shown", "compact", "parseable")


@R.query(f"""SELECT o_orderkey, CASE WHEN sec < 0 THEN '' WHEN sec < 60 THEN 'now' WHEN sec < 3600 THEN sec // 60 || 'm ago' WHEN sec < 86400 THEN sec // 3600 || 'h ago' WHEN sec < 2592000 THEN sec // 86400 || 'd ago'
  WHEN sec < 31104000 THEN sec // 2592000 || 'mo ago' WHEN year(then_) <> {AS_OF[:4]} THEN strftime(then_, '%b ') || day(then_) || ', ' || year(then_) ELSE strftime(then_, '%b ') || day(then_) END AS ago
  FROM (SELECT o_orderkey, then_, CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(then_) AS BIGINT) AS sec FROM (SELECT o_orderkey, o_orderdate + to_seconds(CAST(o_orderkey % 7 * 15000 AS INTEGER)) AS then_ FROM orders))""")
def time_since(spark, sf):
    at = F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 7 * 15000)")
    return table(spark, sf, "orders").select("o_orderkey", T.time_ago(at, F.lit(AS_OF).cast("timestamp_ntz")).alias("ago"))


def _month(s: str) -> str:
    cases = " ".join(f"WHEN {sql.q(k)} THEN {int(v)}" for k, v in V.MONTHS.items())
    return f"(CASE WHEN {sql.has(s, '^[A-Za-z]{3,9}[.]?' + chr(92) + 's+[0-9]{4}$')} THEN CAST(right({s}, 4) AS INTEGER) * 12 + CASE lower({_x(s, '^([A-Za-z]+)', 1)}) {cases} END WHEN {sql.has(s, '^[0-9]{4}$')} THEN CAST({s} AS INTEGER) * 12 + 1 END)"


@R.query(f"""SELECT o_custkey, count(*) AS entries, coalesce(bool_or({_month('e')} < {_month('s')}), false) AS ends_before_start, coalesce(bool_or(CAST({_year('e')} AS INTEGER) >= {AS_OF[:4]} - {V.STUDENT_YEARS}), false) AS student,
  count(ys) >= {V.CAREER_ENTRIES} AND max(ys) - min(ys) < {V.CAREER_YEARS} AS short_career
  FROM (SELECT o_custkey, s, e, CAST({_year('s')} AS INTEGER) AS ys FROM (SELECT o_custkey, CASE WHEN k % 3 = 0 THEN b ELSE a END AS s, CASE WHEN k % 3 = 0 THEN a WHEN k % 3 = 1 THEN z END AS e FROM ({_ORDERS})) x) GROUP BY o_custkey""")
def date_checks(spark, sf):
    """Of each customer's entries: one that ends before it starts, a school year of late, many entries in too few years."""
    e = lines(spark, sf).selectExpr("o_custkey", "CASE WHEN k % 3 = 0 THEN b ELSE a END AS s", "CASE WHEN k % 3 = 0 THEN a WHEN k % 3 = 1 THEN z END AS e")
    return K.entry_checks(e.withColumnsRenamed({"s": "start", "e": "end"}), "o_custkey", int(AS_OF[:4]))


_EMAIL_LIKE = "CASE c_custkey % 4 WHEN 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' WHEN 1 THEN c_name WHEN 2 THEN '' ELSE 'me@' || lower(c_mktsegment) END"
_URL_LIKE = "CASE c_custkey % 5 WHEN 0 THEN 'https://www.example.com/in/' || c_custkey WHEN 1 THEN lower(c_mktsegment) || '.example.org' WHEN 2 THEN c_mktsegment WHEN 3 THEN ' ' ELSE 'ftp://example.com' END"
_DATE_LIKE = "CASE c_custkey % 6 WHEN 0 THEN 'Jan ' || (1990 + c_custkey % 30) WHEN 1 THEN 'Month Year' WHEN 2 THEN '2019 - Present' WHEN 3 THEN c_mktsegment WHEN 4 THEN '' ELSE '3/2020' END"


def _complaint(s: str, pattern: str, message: str) -> str:
    return f"CASE WHEN trim({s}) <> '' AND NOT {sql.has(f'trim({s})', pattern)} THEN {sql.q(message)} END"


@R.query(f"""SELECT c_custkey, CASE WHEN trim(d) = '' THEN NULL WHEN {sql.has('d', V.PLACEHOLDER_FIELD)} THEN {sql.q(V.PLACEHOLDER_MESSAGE)} WHEN NOT {sql.has('d', V.DATE_FIELD)} THEN {sql.q(V.DATE_MESSAGE)} END AS date_error,
  {_complaint('m', V.EMAIL_FIELD, V.EMAIL_MESSAGE)} AS email_error, {_complaint('u', V.URL_FIELD, V.URL_MESSAGE)} AS url_error
  FROM (SELECT c_custkey, {_EMAIL_LIKE} AS m, {_URL_LIKE} AS u, {_DATE_LIKE} AS d FROM customer)""")
def field_complaints(spark, sf):
    """What an editor says of a date, an e-mail address and a URL."""
    from sedgework.functions import shapes as H

    c = table(spark, sf, "customer").selectExpr("c_custkey", f"{_EMAIL_LIKE} AS m", f"{_URL_LIKE} AS u", f"{_DATE_LIKE} AS d")
    return c.select("c_custkey", T.date_complaint(F.col("d")).alias("date_error"), H.email_complaint(F.col("m")).alias("email_error"), H.url_complaint(F.col("u")).alias("url_error"))
