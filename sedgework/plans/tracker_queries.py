"""Queries over tracked records, edits and credentials: orders stand for records, line items for letters, parts for schools and projects, customers for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.functions import pay as P
from sedgework.functions import rewrites as W
from sedgework.functions import values as V
from sedgework.operators import bullets as B
from sedgework.operators import contracts as K
from sedgework.operators import credentials as R_
from sedgework.operators import diagnosis as D
from sedgework.operators import entries as E
from sedgework.operators import exports as X
from sedgework.operators import overlays as O
from sedgework.operators import sections as S
from sedgework.operators import tracker as T
from sedgework.plans import samples, sql
from sedgework.plans.entry_queries import placed_lines
from sedgework.plans.registry import Registry
from sedgework.sources.tables import table

R = Registry()

_JOBS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN 'https://x.org/' || (o_orderkey % 701) END AS url, CASE WHEN o_orderkey % 5 = 0 THEN 'https://y.org/' || o_custkey END AS former, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS title,
  CASE WHEN o_orderkey % 6 < 4 THEN 'note ' || (o_orderkey % 9) END AS notes FROM orders"""
_EACH = f"SELECT id, url AS address FROM ({_JOBS}) WHERE url IS NOT NULL UNION SELECT id, former FROM ({_JOBS}) WHERE former IS NOT NULL"
_PAIR = "SELECT s.id AS survivor, s.id + 1 AS absorbed FROM j s JOIN j a ON a.id = s.id + 1 WHERE s.id % 10 = 0"


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.when(k % 4 != 0, F.concat(F.lit("https://x.org/"), k % 701)).alias("url"), F.when(k % 5 == 0, F.array(F.concat(F.lit("https://y.org/"), "o_custkey"))).alias("alias_urls"),
        F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.when(k % 6 < 4, F.concat(F.lit("note "), k % 9)).alias("notes"),
    )


def merged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    letters = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("letter"), F.col("l_orderkey").alias("job_id"))
    pairs = table(spark, sf, "orders").where("o_orderkey % 10 = 0").selectExpr("o_orderkey AS survivor", "o_orderkey + 1 AS absorbed")
    return T.merged(jobs(spark, sf), letters, pairs)


@R.query(f"SELECT id, min(first_id) AS first_id FROM (SELECT e.id, f.first_id FROM ({_EACH}) e JOIN (SELECT address, min(id) AS first_id FROM ({_EACH}) GROUP BY address) f USING (address) WHERE first_id < id) GROUP BY id")
def same_address(spark, sf):
    """Records that share a present or former address with an earlier one."""
    return T.same_address(jobs(spark, sf))


@R.query(f"""WITH j AS ({_JOBS}), p AS ({_PAIR}), m AS (SELECT s.*, p.absorbed, a.url AS a_url, a.former AS a_former, a.title AS a_title, a.notes AS a_notes FROM j s LEFT JOIN p ON s.id = p.survivor LEFT JOIN j a ON a.id = p.absorbed)
  SELECT id, coalesce(url, a_url) AS url, CASE WHEN title = '' THEN coalesce(nullif(a_title, ''), '') ELSE title END AS title,
    CASE WHEN absorbed IS NULL THEN notes WHEN a_notes IS NULL OR a_notes = notes THEN notes WHEN notes IS NULL THEN a_notes ELSE notes || chr(10) || chr(10) || a_notes END AS notes,
    array_to_string(list_filter(list_distinct([former, a_url, a_former]), lambda u: u IS NOT NULL AND (absorbed IS NULL OR u <> coalesce(url, a_url, ''))), ' ') AS former
  FROM m WHERE id NOT IN (SELECT absorbed FROM p)""".replace("list_distinct([former, a_url, a_former])", "[former, CASE WHEN a_url <> coalesce(former, '') THEN a_url END, CASE WHEN a_former <> coalesce(former, '') AND a_former <> coalesce(a_url, '') THEN a_former END]"))
def merged_jobs(spark, sf):
    """All records after every tenth has absorbed the next."""
    records, _ = merged(spark, sf)
    return records.select("id", "url", "title", "notes", F.coalesce(F.array_join("alias_urls", " "), F.lit("")).alias("former"))


@R.query(f"WITH j AS ({_JOBS}), p AS ({_PAIR}) SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS letter, coalesce(survivor, l_orderkey) AS job_id FROM lineitem LEFT JOIN p ON l_orderkey = absorbed")
def moved_letters(spark, sf):
    """The letters of all records after these merges."""
    return merged(spark, sf)[1]


@R.query("""SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE array_to_string(list_concat(['>> ' || p[1]], p[3:]), chr(10)) END AS text FROM (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents)""")
def accepted_lines(spark, sf):
    """Every document with its first line rewritten and its second removed."""
    lines = F.split("text", "\n")
    change = lambda a, b: F.struct(a.alias("original"), b.cast("string").alias("rewritten"))
    changes = F.array(change(F.get(lines, 0), F.concat(F.lit(">> "), F.get(lines, 0))), change(F.get(lines, 1), F.lit(None)))
    return table(spark, sf, "documents").select("doc_id", T.accepted_lines(F.col("text"), changes).alias("text"))


STATUSES = [(k, t) for k, t in enumerate((
    "US Citizen", "Dual US/UK Citizen", "Global Citizen", "Green card holder.", "Permanent resident of Seattle", "Authorized to work in the US without sponsorship", "Authorized to work with teams", "Right to work in the UK", "Right to Work laws",
    "Work authorization: H-1B", "Citizenship: Hero", "No visa sponsorship required", "EU passport holder", "Vaccine passport holder", "Engineer", "Visa status: TN / OPT",
))]
_SAID = "trim(regexp_replace(trim(regexp_replace(said, '\\s+', ' ', 'g')), '[.;,]$', ''))"


@R.query(f"""SELECT c_custkey, {_SAID} AS status FROM (SELECT id AS c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN said || ' of ' || c_name ELSE said END AS said FROM {sql.dealt('customer', 'c_custkey', STATUSES, 'id, said', ', c_nationkey, c_name')})
  WHERE {sql.has(_SAID, V.STATUS_HINT)} AND ({' OR '.join(sql.has(_SAID, '(?i)' + p) for p in V.STATUS_PATTERNS)})""")
def work_statuses(spark, sf):
    """What each customer's line says of the right to work."""
    c = samples.dealt(spark, sf, "customer", "c_custkey", STATUSES, "id, said")
    said = F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.col("said"), F.lit(" of "), "c_name")).otherwise(F.col("said"))
    return R_.work_authorizations(c.select("c_custkey", F.lit(0).alias("ord"), said.alias("text")), ["c_custkey"])


DEGREES = [(0, "BSc"), (1, "Master of Science"), (2, "B.A."), (3, "Bachelor of Arts"), (4, "PhD")]


@R.query(f"""SELECT id AS p_partkey, p_name || ' College' AS institution, degree, p_type AS field, CASE WHEN p_size % 3 = 0 THEN '3.' || (p_size % 10) END AS gpa, CASE WHEN p_size % 4 = 0 THEN 'magna cum laude' END AS honors, (1990 + p_size) || '' AS ends
  FROM {sql.dealt('part', 'p_partkey', DEGREES, 'id, degree', ', p_name, p_type, p_size')}""")
def school_records(spark, sf):
    """Schools, degrees, fields, grades and honours of entries made of all parts."""
    p = samples.dealt(spark, sf, "part", "p_partkey", DEGREES, "id, degree")
    n = F.col("p_size")
    study = F.concat("degree", F.lit(" in "), "p_type", F.when(n % 4 == 0, ", magna cum laude").otherwise(""), F.when(n % 3 == 0, F.concat(F.lit(", GPA: 3."), n % 10)).otherwise(""))
    heads = F.when(n % 2 == 0, F.array(F.concat("p_name", F.lit(" College")), study)).otherwise(F.array(study, F.concat("p_name", F.lit(" College | Berlin"))))
    blocks = p.select("p_partkey", heads.alias("header_lines"), (n + 1990).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("body"))
    return R_.education(blocks).select("p_partkey", "institution", "degree", "field", "gpa", "honors", F.col("dates.end").alias("ends"))


@R.query("""SELECT p_partkey, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'github.com/me/' || p_partkey WHEN p_size % 3 = 1 THEN 'https://x' || p_partkey || '.org' END AS url, CAST(CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.6 END AS DOUBLE) AS confidence FROM part""")
def project_records(spark, sf):
    """Projects of entries made of all parts: names, links, confidence."""
    n, key = F.col("p_size"), F.col("p_partkey")
    link = F.when(n % 3 == 0, F.concat(F.lit(" | github.com/me/"), key)).when(n % 3 == 1, F.concat(F.lit(" - https://x"), key, F.lit(".org"))).otherwise("")
    blocks = table(spark, sf, "part").select("p_partkey", F.array(F.concat("p_name", link), F.lit("React")).alias("header_lines"), F.lit("2020").alias("start"), F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("body"), F.when(n % 2 == 0, 2).otherwise(0).alias("bullets"))
    return R_.projects(blocks).select("p_partkey", "name", "url", "confidence")


PAYS = [(k, t) for k, t in enumerate((
    "Salary: $120,000 - $150,000 per year", "£45k to £60K", "EUR 30–35/hr for you", "between $90k and 110k annually", "saved $5 and 20 people", "raised $5M and we pay $100k", "$50 billion market", "Pay: CAD 8,500/month", "costs $29/month", "$75/hr", "no pay",
))]


@R.query()
def pay_figures(spark, sf):
    """Pay in several currencies, in a line of each part between two others."""
    p = samples.dealt(spark, sf, "part", "p_partkey", PAYS, "id, said")
    text = F.concat("p_name", F.lit(". "), "said", F.lit("; "), "p_type")
    return p.select("p_partkey", F.explode(F.array_compact(F.array(P.pay(text)))).alias("p")).select("p_partkey", "p.*")


_LIST = "SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS t FROM orders GROUP BY o_custkey"


@R.query(f"""SELECT c_custkey, array_to_string(list_concat(list_filter(list_transform(coalesce(t, []), lambda x, i: CASE WHEN i = 1 AND c_custkey % 2 = 0 THEN 'Lead' WHEN i = 2 AND c_custkey % 5 = 0 THEN NULL ELSE x END), lambda x: x IS NOT NULL), CASE WHEN c_custkey % 7 = 0 THEN ['Chief'] ELSE [] END), '|') AS titles,
  CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS phone, CAST(len(coalesce(t, [])) + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS lines FROM customer LEFT JOIN ({_LIST}) ON c_custkey = o_custkey""")
def applied_overrides(spark, sf):
    """Every customer's record of orders after edits of a field, an entry removed, one added and a bullet rewritten."""
    o = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey"))
    none = F.lit(None).cast("string")
    entry = O.entry({f: none for f in O.FIELDS} | {"title": F.col("o_orderpriority"), "current": F.lit(False), "description": F.concat(F.lit("did "), "o_orderkey")})
    by = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("k").isNull(), "k", entry.alias("e")))).alias("es"))
    c = table(spark, sf, "customer").join(by, "c_custkey", "left")
    es = F.coalesce(F.transform("es", lambda x: x["e"]), F.array().cast(f"array<{O.ENTRY}>"))
    k = F.col("c_custkey")
    chief = O.entry({f: none for f in O.FIELDS} | {"title": F.lit("Chief"), "current": F.lit(False), "description": none})
    # a customer and its edits are one row: a key that the table has twice is not multiplied
    rows = c.select(
        "c_custkey", F.create_map(F.lit("phone"), "c_mktsegment").alias("contact"), es.alias("experience"), F.transform(es, lambda e: F.concat(F.lit("• "), e["description"])).alias("lines"), k.isNotNull().alias("has_edits"),
        F.when(k % 3 == 0, F.create_map(F.lit("phone"), F.lit("new"))).alias("e_contact"), F.when(k % 2 == 0, F.create_map(F.lit("experience:0:title"), F.lit("Lead"))).alias("e_fields"), F.when(k % 5 == 0, F.array(F.lit("experience:1"))).alias("e_removed"),
        F.when(k % 7 == 0, F.array(F.struct(F.lit("added:1").alias("id"), F.lit("experience").alias("section"), chief.alias("entry")))).alias("e_added"), F.when(k % 7 == 0, F.create_map(F.lit("added:1"), F.array(F.lit("Led")))).alias("e_added_bullets"),
    )
    out = O.applied_rows(rows, "has_edits")
    return out.select("c_custkey", F.array_join(F.transform("experience", lambda e: e["title"]), "|").alias("titles"), F.col("contact")["phone"].alias("phone"), F.size("lines").alias("lines"))


@R.query()
def parse_defects(spark, sf):
    """What a parse of every document's lines into sections and dated entries has missed."""
    lines = S.sections(placed_lines(spark, sf), ["doc_id"])
    found = S.by_name(lines, ["doc_id"])
    roles = E.entry_blocks(lines.where("section = 'experience' AND NOT is_heading"), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("section", F.lit("experience"))
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit("# My Technical skills\nSQL")).alias("md"))
    return D.defects(docs, found, roles, "doc_id", "md").select("doc_id", F.array_join("defects", ",").alias("defects"), F.array_join("missed", ",").alias("missed"))


_K = "c_custkey"


@R.query(f"""SELECT {_K}, array_to_string(list_filter([CASE WHEN {_K} % 5 = 0 THEN '`id` must be a non-empty string.' END, CASE WHEN {_K} % 4 = 0 THEN '`title` is required and must be a string.' END, CASE WHEN {_K} % 7 = 0 THEN '`createdAt` must be a finite number.' END], lambda x: x IS NOT NULL), '|') AS reasons,
  CASE WHEN {_K} % 5 > 0 AND {_K} % 4 > 0 AND {_K} % 7 > 0 THEN c_mktsegment END AS kept FROM customer""")
def record_contracts(spark, sf):
    """What is wrong with the JSON records made of all customers, and a further field of those that are right."""
    n = F.col(_K)
    made = F.to_json(F.struct(F.when(n % 5 == 0, "").otherwise(n.cast("string")).alias("id"), F.when(n % 4 != 0, F.col("c_name")).alias("title"), F.lit("firm").alias("company"), F.lit("new").alias("status"), F.lit(1).alias("createdAt"), F.lit(2.5).alias("updatedAt"), F.col("c_mktsegment").alias("segment")))
    json = F.when(n % 7 == 0, F.replace(made, F.lit('"createdAt":1'), F.lit('"createdAt":"1"'))).otherwise(made)
    found = K.checked(table(spark, sf, "customer").select(_K, json.alias("json")), "json", K.JOB)
    return found.select(_K, F.array_join("reasons", "|").alias("reasons"), F.col("extras")["segment"].alias("kept"))


def resumes(spark: SparkSession, sf: str) -> DataFrame:
    """A record of every customer: contact data and one role."""
    n, none = F.col(_K), F.lit(None).cast("string")
    role = O.entry({f: none for f in O.FIELDS} | {"title": F.col("c_mktsegment"), "subtitle": F.concat(F.lit("Nation "), "c_nationkey"), "start": F.lit("Jan 2019"), "end": F.when(n % 2 == 0, "2021"), "current": n % 2 == 1, "description": F.when(n % 3 == 0, "Built A\nRan B")})
    contact = F.map_filter(F.create_map(F.lit("full_name"), F.col("c_name"), F.lit("email"), F.when(n % 4 > 0, F.concat(F.lit("me"), n, F.lit("@x.org")))), lambda _, v: v.isNotNull())
    empty = F.array().cast(f"array<{O.ENTRY}>")
    return table(spark, sf, "customer").select(_K, contact.alias("contact"), none.alias("summary"), F.array(role).alias("experience"), empty.alias("education"), empty.alias("projects"), empty.alias("achievements"), empty.alias("certifications"), F.array(F.lit("SQL")).alias("skills"))


_PARTS = ("contact", "summary", "experience", "education", "projects", "achievements", "certifications", "skills")


@R.query(f"""SELECT {_K}, '{{"basics":{{"name":"' || c_name || '"' || CASE WHEN {_K} % 4 > 0 THEN ',"email":"me' || {_K} || '@x.org"' ELSE '' END || '}},"work":[{{"name":"Nation ' || c_nationkey || '","position":"' || c_mktsegment || '","startDate":"2019-01"'
  || CASE WHEN {_K} % 2 = 0 THEN ',"endDate":"2021"' ELSE '' END || CASE WHEN {_K} % 3 = 0 THEN ',"highlights":["Built A","Ran B"]' ELSE '' END || '}}],"skills":[{{"name":"SQL"}}]}}' AS json FROM customer""")
def json_resumes(spark, sf):
    """Every customer's record in the open schema of résumés."""
    return resumes(spark, sf).select(_K, X.json_resume(*map(F.col, _PARTS)).alias("json"))


@R.query(f"""SELECT {_K}, '# ' || c_name || chr(10) || chr(10) || CASE WHEN {_K} % 4 > 0 THEN 'me' || {_K} || '@x.org' || chr(10) || chr(10) ELSE '' END || '## Experience' || chr(10) || chr(10) || '### ' || c_mktsegment || ' — Nation ' || c_nationkey || ' · Jan 2019 – '
  || CASE WHEN {_K} % 2 = 0 THEN '2021' ELSE 'Present' END || CASE WHEN {_K} % 3 = 0 THEN chr(10) || '- Built A' || chr(10) || '- Ran B' ELSE '' END || chr(10) || chr(10) || '## Skills' || chr(10) || chr(10) || 'SQL' AS md FROM customer""")
def markdown_resumes(spark, sf):
    """Every customer's record as markdown."""
    return resumes(spark, sf).select(_K, X.markdown(*map(F.col, _PARTS)).alias("md"))


@R.query("""SELECT p_partkey, p_brand AS type, p_name || ' · ' || p_type AS rest FROM part WHERE p_size % 3 = 0""")
def split_labels(spark, sf):
    """The label before a title, where it is short and there is one."""
    n = F.col("p_size") % 3
    title = F.when(n == 0, F.concat_ws(" · ", "p_brand", "p_name", "p_type")).when(n == 1, F.concat(F.repeat("p_name", 9), F.lit(" · "), "p_type")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", W.split_label(title).alias("s")).where("s IS NOT NULL").select("p_partkey", "s.*")


@R.query(f"""SELECT p_partkey, regexp_replace('cut ' || p_size || '% of $' || (p_size * 100) || 'K for ' || p_size || ' ' || CASE WHEN p_size % 2 = 0 THEN 'users' ELSE 'uses' END || ' of ' || p_name, {sql.q(V.BOLD_METRIC)}, '<\\1>', 'g') AS text FROM part""")
def bold_metrics(spark, sf):
    """Lines of all parts with their metrics marked."""
    n = F.col("p_size")
    line = F.concat(F.lit("cut "), n, F.lit("% of $"), n * 100, F.lit("K for "), n, F.lit(" "), F.when(n % 2 == 0, "users").otherwise("uses"), F.lit(" of "), "p_name")
    return table(spark, sf, "part").select("p_partkey", F.translate(W.bold_metrics(line), W.OPEN + W.CLOSE, "<>").alias("text"))


@R.query()
def clean_rewrites(spark, sf):
    """The sentences of every turn behind marks that a model may put before them."""
    said = F.split("text", "(?<=[.?!]) ")
    marks = F.array(*map(F.lit, ("- **Made** ", "1. ", "Rewritten: * ", "", "Here are the rewritten ", '"')))
    line = F.transform(said, lambda s, i: F.concat(F.element_at(marks, i % 6 + 1), s))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(line).alias("ord", "line"))
    return turns.select("conv_id", "turn", "ord", W.clean_line(F.col("line")).alias("line"))


@R.query()
def marked_bullets(spark, sf):
    """Bullets of all documents' lines, some of whose marks stand on lines of their own."""
    lines = B.lines(table(spark, sf, "documents").select("doc_id", "text"))
    k = (F.col("doc_id") + F.col("ord")) % 5
    line = F.when(k == 0, "•").when(k == 2, F.concat(F.lit("- "), "line")).when(k == 3, F.concat(F.lit("2. "), "line")).otherwise(F.col("line"))
    return B.marked_bullets(lines.withColumn("line", line), ["doc_id"])
