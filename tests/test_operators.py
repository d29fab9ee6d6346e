"""Operators on small inputs: the cases that the tables do not hold."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedgework.functions import dates as T
from sedgework.functions import labels as L
from sedgework.functions import shapes as H
from sedgework.functions import text as X
from sedgework.functions import urls as U
from sedgework.operators import bullets as B
from sedgework.operators import matching as M
from sedgework.operators import parses as P
from sedgework.operators import quality as Q
from sedgework.operators import records as D
from sedgework.operators import search as K
from sedgework.operators import skills
from sedgework.operators import store as S
from sedgework.sources import feeds, jsonld
from sedgework.streaming import events as E


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "line,quantified",
    [
        ("Grew revenue 12.5% last year", True), ("Saved $2M in 2023", True), ("From 2013 to 2021 at Acme", False), ("Shipped two internal tools", True),
        ("reduced churn by three", False), ("Led Six Sigma initiatives", False), ("since two thousand nineteen", False), ("processed two thousand records", True),
        ("a four-month migration", True), ("two-thousand-nineteen plan", False), ("3x faster", True), ("nothing here", False), ("2019 2020 2021", False),
    ],
)
def test_metric(spark, line, quantified):
    assert one(spark, X.has_metric(F.col("t")), t=line) is quantified


@pytest.mark.parametrize(
    "url,form",
    [
        ("HTTPS://WWW.Example.com./en-US//a/b/?utm_source=x&b=2&a=1#f", "https://example.com/a/b?a=1&b=2"), ("http://e.com:8080", "http://e.com:8080/"),
        ("ftp://e.com/a", None), ("/relative", None), ("https://e.com/en/us", "https://e.com/en/us"), ("https://e.com/?REF=1", "https://e.com/"),
    ],
)
def test_canonical(spark, url, form):
    assert one(spark, U.canonical(F.col("u")), u=url) == form


def test_canonical_is_idempotent(spark):
    urls = [(f"http{s}://{w}Ex{i}.org/{p}?z={i}&utm_x=1&a={i}",) for i, (s, w, p) in enumerate([("", "www.", "de-DE/x//y"), ("s", "", ""), ("s", "WWW.", "a/")])]
    once = spark.createDataFrame(urls, "u string").select(U.canonical(F.col("u")).alias("u"))
    assert once.select((U.canonical(F.col("u")) == F.col("u")).alias("same")).distinct().collect()[0].same


def test_ids_skip_claimed_numbers(spark):
    rows = spark.createDataFrame([(1, k, "- Same  Line here") for k in range(4)], "g int, ord int, bullet string")
    claimed = spark.createDataFrame([(1, "same line here", 0), (1, "same line here", 2)], "g int, key string, occurrence int")
    got = [r.bullet_id for r in B.free_ids(rows, claimed, "g").orderBy("ord").collect()]
    assert got == [f"{k}|same line here" for k in (1, 3, 4, 5)]


def test_pairs_within_days_match_all_pairs(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, i % 3, start + timedelta(hours=37 * i * i % 2000)) for i in range(60)] + [(99, 1, None)]
    df = spark.createDataFrame(rows, "id int, grp int, at timestamp")
    got = {(r.a, r.b) for r in D.pairs_within_days(df, ["grp"], "id", "at", 5).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] and b[2] and abs((a[2] - b[2]).total_seconds()) <= 5 * 86400}
    assert got == want


def test_clusters_by_span_and_unusable_times(spark):
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    rows = [("a", day(0)), ("a", day(21)), ("b", day(0)), ("b", day(22)), ("c", day(0)), ("c", None), ("d", day(0))]
    got = {r.k: (r.members, r.span_days) for r in D.repost_clusters(spark.createDataFrame(rows, "k string, at timestamp"), ["k"], "at").collect()}
    assert got == {"b": (2, 22), "c": (2, None)}


def test_company_and_record_keys(spark):
    df = spark.createDataFrame([("Acme Inc.", "Dev"), ("ACME", "dev!"), ("Limited", "x"), ("", "y"), (None, "z"), ("Foo Co GmbH Ltd", "A  b")], "c string, t string")
    assert [r.k for r in df.select(D.record_key(F.col("c"), F.col("t")).alias("k")).collect()] == ["acme\tdev", "acme\tdev", "limited\tx", None, None, "foo co\ta b"]


def test_notes(spark):
    df = spark.createDataFrame([("a", "b"), ("a", " a "), ("", "b"), ("a", None), (None, None)], "k string, v string")
    assert [r.n for r in df.select(D.joined_notes(F.col("k"), F.col("v")).alias("n")).collect()] == ["a\n\nb", "a", "b", "a", None]


def test_rating_bounds_and_missing_axes(spark):
    rows = [(0.0, None, None, None), (9.0, 180000.0, True, 0), (50.0, 20000.0, False, 9), (1e6, 1e9, True, 1)]
    df = spark.createDataFrame(rows, "b double, p double, l boolean, d int")
    for floor in (None, 100000.0):
        got = df.select(*[v.alias(k) for k, v in M.rating(F.col("b"), F.col("p"), floor, F.col("l"), F.col("d")).items()]).collect()
        assert all(0 <= r.overall <= 5 for r in got)
        assert got[0].overall == 0 and got[0].compensation is None and got[0].seniority is None
    assert got[2].seniority == 0 and got[2].location == 2.5


def test_upsert_is_idempotent_and_keeps_creation(spark):
    t = lambda d: datetime(2024, 1, d)
    schema = "id int, v string, created_at timestamp, updated_at timestamp"
    base = spark.createDataFrame([(1, "a", t(1), t(1)), (2, "b", t(1), t(1))], schema)
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    now = F.lit("2024-01-09 00:00:00").cast("timestamp")
    once = S.upsert(base, new, "id", now)
    got = {r.id: (r.v, r.created_at.day, r.updated_at.day) for r in once.collect()}
    assert got == {1: ("a", 1, 1), 2: ("B", 1, 9), 3: ("C", 9, 9)}
    assert sorted(S.upsert(once, new, "id", now).collect()) == sorted(once.collect())
    assert {r.id: r.updated_at.day for r in S.upsert(base, new, "id", now, touch=False).collect()}[2] == 1


def test_soft_delete_only_once(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), None), (2, datetime(2024, 1, 1), datetime(2024, 1, 2))], "id int, updated_at timestamp, deleted_at timestamp")
    gone = S.soft_delete(df, spark.createDataFrame([(1,), (2,), (9,)], "id int"), "id", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    got = {r.id: (r.updated_at.month, r.deleted_at.month) for r in gone.collect()}
    assert got == {1: (2, 2), 2: (1, 1)} and S.live(gone).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert B.pool_scores(B.features(B.bullets(none)), "doc_id").count() == 0
    assert M.noun_phrases(none, "doc_id", "text").count() == 0
    assert Q.align_lines(none.withColumn("other", F.col("text")), "text", "other").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c", max_size=8), max_size=6), st.lists(st.text("ab c", max_size=8), max_size=6))
def test_alignment_covers_every_line_in_order(a, b):
    pairs = Q.aligned(a, b)
    assert [i for i, _ in pairs if i is not None] == list(range(len(a)))
    assert [j for _, j in pairs if j is not None] == list(range(len(b)))
    assert all(Q.dice(Q.words_of(a[i]), Q.words_of(b[j])) >= 0.3 for i, j in pairs if i is not None and j is not None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("xyz"), max_size=8), st.lists(st.sampled_from("xyz"), max_size=8))
def test_dice_is_symmetric(a, b):
    assert Q.dice(a, b) == Q.dice(b, a) and 0 <= Q.dice(a, b) <= 1 and Q.dice(a, a) == 1


def test_word_diff_restores_both(spark):
    df = spark.createDataFrame([("a b  c", "a x c d"), (None, "new"), ("old", None), ("", "")], "a string, b string")
    for r in df.select("a", "b", Q.word_diff("a", "b").alias("d")).collect():
        assert "".join(p.text for p in r.d if p.kind != "added") == (r.a or "")
        assert "".join(p.text for p in r.d if p.kind != "removed") == (r.b or "")


def test_json_repair():
    assert Q.first_json('x {bad {"a": 1} y') == '{"a":1}'
    assert Q.first_json('```json\n[1, 2]\n```', "[") == "[1,2]"
    assert Q.first_json(None) is None


def test_markdown(spark):
    from sedgework.plans.samples import MARKDOWN

    df = spark.createDataFrame(MARKDOWN, "id int, md string")
    assert df.select(feeds.markdown_text(F.col("md")).alias("x")).first().x == "Title\nSee docs https://a.example/x and bold code \nquoted me@a.example"
    assert {(r.label, r.url) for r in feeds.link_definitions(df, "id", "md").collect()} == {("a", "https://one.example"), ("b", "https://b.example")}


def test_rows_of_items(spark):
    items = [(1, 1, 5.0, 100.0, "b"), (1, 1, 1.0, 102.0, "a"), (1, 1, 1.0, 97.0, "c"), (1, 2, 1.0, 97.0, "d")]
    got = {r.str: r.row for r in Q.rows_of_items(spark.createDataFrame(items, "doc_id int, page int, x double, y double, str string")).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 0}


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=17 * i), i % 4, "click" if i % 3 else "view", float(i)) for i in range(200)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    batch = spark.createDataFrame(rows, schema).repartition(4)
    batch.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    E.write_all(E.funnel(live, "6 hours", "10 days"), str(tmp_path / "out"), str(tmp_path / "cp"), "complete").awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(E.funnel(batch, "6 hours").collect())


def test_changes_resume_from_the_checkpoint(spark, tmp_path):
    seen = []

    def merge(batch, _):
        seen.append(sorted(r.id for r in batch.collect()))

    spark.range(3).write.parquet(str(tmp_path / "in"))
    for more in (None, 5):
        if more:
            spark.range(3, more).write.mode("append").parquet(str(tmp_path / "in"))
        E.apply_changes(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), merge, str(tmp_path / "cp")).awaitTermination()
    assert seen == [[0, 1, 2], [3, 4]]


def many(spark, column, values: list, name: str = "t") -> list:
    """A column of one text column over several values, in their order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, {name} string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_date_ranges(spark):
    lines = ["Jan 2020 - Present", "Mar. 2016 Exp. Jun. 2017", "Summer 2013, 2014", "Head of Marketing 2020", "Month Year - Present", "2019 – Month Year", "tinylm | Link Jan. 2026", "5000", "Dec '00 to May '02", "", None]
    got = [(r.start, r.end, r.current) if r else None for r in many(spark, T.date_range(F.col("t")), lines)]
    assert got[:9] == [("Jan 2020", None, True), ("Mar. 2016", "Jun. 2017", False), ("Summer 2013", "2014", False), ("2020", None, False), (None, None, False), ("2019", None, False), ("Jan. 2026", None, False), (None, None, False), ("Dec '00", "May '02", False)]
    assert got[9] == (None, None, False)
    assert many(spark, T.without_dates(F.col("t")), ["Tech Lead: 2020", "Globex, Jan 2020 - Present", "Award (2019)", "tinylm | Link Jan. 2026", "Marketing 2021 - 2022"]) == ["Tech Lead", "Globex", "Award", "tinylm | Link", "Marketing"]
    assert many(spark, T.date_separator(F.col("t")), ["Globex Excellence, 2021", "Award · 2021", "Lead 2020", "2020"]) == [",", "·", None, None]
    assert many(spark, T.is_lone_range(F.col("t")), ["Jan 2024 – Present", "2019 - 2021", "5000 - 6000", "Fall 2013 – Spring 2014", "2020", "Acme 2019 - 2021"]) == [True, True, False, False, False, False]


def test_line_shapes(spark):
    prose = "Improved the accomplishments. Where the team was in need we helped"
    assert many(spark, H.is_prose(F.col("t")), [prose, "Staff Engineer at the old Northwind Technology. San Jose, California, USA", "Short. It is"]) == [True, False, False]
    assert many(spark, H.is_entry_header(F.col("t")), ["Staff Engineer", "GPA: 3.8", "2019 - 2021", "lower case", prose, ""]) == [True, False, False, False, False, False]
    assert many(spark, H.looks_like_company(F.col("t")), ["Globex LLC", "State University", "University Lecturer", "Staff Engineer"]) == [True, True, False, False]
    assert many(spark, H.is_scope_prose(F.col("t")), ["Founding leader; owned charter", "IC4 · Platform", "Led growth across teams", "Acme Inc.", "Done.", "Globex"]) == [True, True, True, False, True, False]
    assert many(spark, H.is_page_furniture(F.col("t")), ["Jane Doe · Résumé 2", "Jane CV 2", "Cardiovascular (CV) Fellowship", "Presumed"]) == [True, True, False, False]
    assert many(spark, H.title_key(F.col("t")), ["• Catalogs. [2019]", "Award, 2021", "Plain"]) == ["catalogs.", "award", "plain"]


def test_labels(spark):
    assert many(spark, L.tight_letters(F.col("t")), ["J O H N  D O E", "a b c", "W O R K at it"]) == ["JOHN  D O E", "a b c", "WORK at it"]
    assert many(spark, L.joined_letter(F.col("t")), ["S kills", "A b", "e xperience"]) == ["Skills", "A b", "experience"]
    assert many(spark, L.id_text(F.col("t")), ["0|led it", "x|no", "3|", "12|a|b"]) == ["led it", None, None, "a|b"]
    assert many(spark, L.slug(F.col("t")), [" Zoë O'Neil ", None]) == ["zo-oneil", ""]


def test_query_terms_and_scores(spark):
    assert K.query_terms(["Sr. Data Engineer of the North"], ["C++", "go", "the", " Steel "], ("north",)) == ["data", "engineer", "c++", "steel"]
    assert many(spark, K.matches_query(F.col("t"), F.lit(""), ["c++", "data"]), ["Uses C++, daily", "database", "Data"]) == [True, False, True]
    assert many(spark, K.loosely_equal(F.col("t"), F.lit("development")), ["developer", "develop", "dev", "devices"]) == [True, True, False, False]
    assert many(spark, K.without_operators(F.col("t")), ["- -go C++ a-b"]) == ["go C++ a-b"]
    assert many(spark, K.title_score(F.col("t"), F.lit(None).cast("array<string>"), ["Senior Data Engineer"], "Senior"), ["Data Engineer", "Senior Data Engineer", "Cook"]) == [20, 34, 0]


def test_skills(spark):
    words = [("rails", "Rails", ["ruby on rails"]), ("ruby", "Ruby", ["ruby"]), ("cpp", "C++", ["c++"]), ("node", "Node.js", ["node.js", "node"])]
    df = spark.createDataFrame([(1, "Ruby on Rails, ruby/C++ (node.js)"), (2, "rubyist c++x"), (3, None)], "id int, t string")
    got = {(r.id, r.skill): r.n for r in skills.mentions(df, "id", "t", words).collect()}
    assert got == {(1, "rails"): 1, (1, "ruby"): 1, (1, "cpp"): 1, (1, "node"): 1}
    terms = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("source")) for n, s in (("ruby", "skill"), ("rails", "skill"), ("team lead", "noun"))])
    df = spark.createDataFrame([(1, "ruby and a team lead"), (2, ""), (3, None)], "id int, t string").withColumn("terms", terms)
    assert [(r.covered, r.missing, r.score) for r in skills.coverage(df, "t", "terms", words).orderBy("id").collect()] == [("ruby,team lead", "rails", 60), ("", "ruby,rails,team lead", 0), ("", "ruby,rails,team lead", 0)]


def test_reference_links(spark):
    md = ["[a][b c] and [d][] ![i][b c]\n[B  C]: https://x.example 't'\n[d]: www.y.example", "[a][b]", None]
    assert many(spark, feeds.resolved_links(F.col("t")), md) == ["a https://x.example and d www.y.example \n\n", "[a][b]", None]


def test_jsonld(spark):
    docs = ['{"@context":"https://schema.org","@graph":[{"@type":"Thing"},{"@type":"JobPosting","title":"x"}]}', '[{"@type":"JobPosting","@context":["https://schema.org"],"title":"y","jobLocationType":["TELECOMMUTE"]}]', '{"@type":"JobPosting","title":"z"}', "{broken", None, ""]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, j string")
    assert sorted((r.id, r.title, r.work_model) for r in jsonld.postings(df, "id", "j").collect()) == [(0, "x", None), (1, "y", "remote")]


def test_set_scores_of_rows(spark):
    """Lists as rows score as lists do; the members of a list are not compared one by one."""
    rows = [("a", "X ", True, False), ("a", "x", False, True), ("a", "y", False, True), ("a", "x", False, True), ("b", "z", False, False), ("c", None, False, True)]
    got = {r.k: (r.jaccard, round(r.recall, 6)) for r in P.set_scores_of(spark.createDataFrame(rows, "k string, m string, g boolean, t boolean"), ["k"], "m", F.col("g"), F.col("t")).collect()}
    assert got == {"a": (0.5, 0.666667), "b": (1.0, 1.0), "c": (1.0, 0.0)}
