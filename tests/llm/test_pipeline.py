"""Main text of pages, and the pipeline as a whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sedgework.llm import html_wrapper
from sedgework.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def page(n: int, body: str, noise: str = "") -> str:
    return f"<html><head><title>t{n}</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a><a>About us</a></nav>{noise}<article><h1>Title &amp; {n}</h1>{body}</article><footer>All rights reserved</footer><script>var x='</p>';</script></body></html>"


def test_main_text(spark):
    rows = [(i, "https://a.example/x", page(i, f"<p>First  text number {i} with\n words.</p><p>Second <b>one</b> of page {i}.</p>")) for i in range(8)]
    rows += [(100, "https://b.example/", None), (101, None, ""), (102, "https://a.example/x", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("extra", F.lit(1))
    got = {r.page_id: r for r in html_wrapper.main_text(df).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "Title & 3\n\nFirst text number 3 with words.\n\nSecond one of page 3."
    assert got[102].text == got[0].text and got[3].n_chars == len(got[3].text) and got[3].extra == 1
    assert got[100].text == got[101].text == ""
    assert html_wrapper.main_text(df.limit(0)).count() == 0


def texts_of(pages: list[str]) -> list[str]:
    wrapper = html_wrapper.induce(pages[:12], html_wrapper.Settings())
    return [html_wrapper.extract(p, wrapper) for p in pages]


def test_main_text_beside_the_body():
    """Pages without article or main: a title, a lead and a second body beside the largest container."""
    def one(n: int, more: str = "") -> str:
        return f"<html><body><nav><a>Home</a></nav><div class=site>The same on all</div><div class=page><h1>Title {n}</h1><p>Lead of {n}.</p><div class=body><p>{f'Long text number {n}. ' * 9}</p></div><div class=rest><p>Second part {n}.</p></div>{more}</div><footer>All rights reserved</footer></body></html>"

    pages = [one(n) for n in range(14)] + [one(14, "<div class=once><p>Seen on one page.</p></div>")]
    got = texts_of(pages)
    for n, text in enumerate(got):
        assert text.split("\n\n") == [f"Title {n}", f"Lead of {n}.", ("Long text number %d. " % n * 9).strip(), f"Second part {n}.", *["Seen on one page."] * (n == 14)]


def test_main_text_of_all_articles():
    pages = [f"<html><body><div><h1>Title {n}</h1></div><article class=a><p>{f'First story {n}. ' * 9}</p></article><article class=b><p>Second story {n}.</p></article></body></html>" for n in range(6)]
    for n, text in enumerate(texts_of(pages)):
        assert text.split("\n\n") == [f"Title {n}", (f"First story {n}. " * 9).strip(), f"Second story {n}."]
    assert html_wrapper.extract(pages[0], None).count("story 0") == 10


def test_main_text_of_elements_named_as_boilerplate():
    """Inside the content such names drop only what all pages have; outside they drop all."""
    for start, end in (("<article>", "</article>"), ("<div class=text>", "</div>")):
        pages = [
            f"<html><body><nav>Home</nav><div class=ad>Buy {n}</div><aside>Teaser {n}</aside>{start}<div class='article-header'><h1>Title {n}</h1></div><header>By {n}</header>"
            f"<h2 id='related-work'>Related work {n}</h2><section id='search-algorithms'><p>{f'Long text {n}. ' * 9}</p></section><p class='notice'>Mind {n}.</p>"
            f"<div class='share'>Share this page</div><form>Login {n}</form>{end}</body></html>"
            for n in range(8)
        ]
        for n, text in enumerate(texts_of(pages)):
            assert text.split("\n\n") == [f"Title {n}", f"By {n}", f"Related work {n}", (f"Long text {n}. " * 9).strip(), f"Mind {n}."]
    held = [f"<html><body><div class='header-wrap'><article><p>Inside {n}.</p></article></div><p>Beside {n}.</p></body></html>" for n in range(5)]
    assert texts_of(held) == [f"Inside {n}.\n\nBeside {n}." for n in range(5)]


def test_main_text_by_number_of_pages():
    """A short text that the pages of a host agree on is template from two pages on, a long one needs more of them."""
    def one(n: int) -> str:
        return f"<html><body><div class=site>Read well, live well</div><div class=long>{'A long constant text. ' * 10}</div><div class=page><h1>Title {n}</h1><p>{f'Long text number {n}. ' * 9}</p></div></body></html>"

    long = ("A long constant text. " * 10).strip()
    for pages in (1, 2, 3, 4, 8):
        blocks = texts_of([one(n) for n in range(pages)])[0].split("\n\n")
        assert blocks[-2:] == ["Title 0", ("Long text number 0. " * 9).strip()]
        assert ("Read well, live well" in blocks) == (pages == 1)
        assert (long in blocks) == (pages <= 2)


def test_main_text_of_some_pages():
    """A constant that a part of the pages has goes outside of the content region and stays inside."""
    def one(n: int) -> str:
        some = "<div class=x>Closed on Monday</div>" * (n % 2)
        return f"<html><body>{some}<article><h1>Title {n}</h1>{some}<p>{f'Text {n}. ' * 9}</p></article></body></html>"

    for n, text in enumerate(texts_of([one(n) for n in range(12)])):
        assert text.split("\n\n") == [f"Title {n}", *["Closed on Monday"] * (n % 2), (f"Text {n}. " * 9).strip()]


def test_main_text_of_odd_markup(spark):
    """Deep, unclosed and very long markup costs time in proportion and loses no text."""
    deep = "<div>" * 100_000 + "<p>core</p>" + "</div>" * 100_000
    pages = [deep, "<b>" * 100_000 + "core", "core " + "<b " * 300_000, "core" + "<a x=\"" * 100_000, "<p>core</p>" + "".join(f"<h{i % 5 + 1}>{i}</h{i % 5 + 1}>" for i in range(5_000)), "<p>" + "core " * 200_000, "core<!-- never closed " + "<p>x</p>" * 1000, "core<script>never closed <p>x</p>", "</p></div>core</html><p>"]
    df = spark.createDataFrame([(i, f"https://h{i}.example/", p) for i, p in enumerate(pages)] + [(99, "https://h0.example/", deep.replace("core", "else"))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrapper.main_text(df).collect()}
    assert got[0] == "core" and got[99] == "else" and got[1] == "core"
    assert all(t.startswith("core") for i, t in got.items() if i != 99)
    assert len(got[5]) == 5 * 200_000 - 1 and got[4].count("\n\n") == 5_000 and got[6] == got[7] == "core"


def test_tree_matching_against_brute_force():
    """The matching of two small trees is as large as the best of all order-keeping matchings."""
    import random

    def best(a, b) -> int:
        if a["l"] != b.label:
            return 0
        x, y = a["c"], [g[0] for _, g in b.groups]

        def over(i: int, j: int) -> int:
            if i == len(x) or j == len(y):
                return 0
            return max(over(i + 1, j), over(i, j + 1), best(x[i], y[j]) + over(i + 1, j + 1) if x[i]["l"] == y[j].label else 0)

        return 1 + over(0, 0)

    rng = random.Random(3)

    def tree(depth: int) -> str:
        return "".join(f"<{t}>{tree(depth - 1) if depth else rng.random()}</{t}>" for t in rng.choices(["div", "i", "u", "s"], k=rng.randint(0, 4)))

    for _ in range(60):
        pages = [html_wrapper.parse(tree(3)) for _ in range(2)]
        w = html_wrapper.leaf(pages[0])
        html_wrapper.merge(w, pages[0], 0, html_wrapper.Matching())
        assert html_wrapper.Matching().size(w, pages[1]) == best(w, pages[1])
    assert html_wrapper.in_order(list("abcab"), list("bacab")) in ([(0, 1), (2, 2), (3, 3), (4, 4)], [(1, 0), (2, 2), (3, 3), (4, 4)])


def test_pages_of_the_tables(spark):
    got = QUERIES["op4_html_wrapper"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) for r in got)
    assert not any("<p>" in r.text or "track(" in r.text for r in got)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, SF))
        assert kept.columns == columns, name
        seen.append(kept.count())
    assert seen == sorted(seen, reverse=True) and seen[1] < seen[0] and seen[3] < seen[2] and seen[4] == seen[3]
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == seen[-1]
    # two thirds of some 90 labels are few to learn from; accuracy is tested on the larger table
    toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").select("doc_id")
    assert packed.join(toxic, "doc_id", "left_semi").select("doc_id").distinct().count() <= 0.5 * toxic.count()


def test_pipeline_of_odd_rows(spark):
    """Nulls, empty and repeated rows and columns that have the operators' names pass all stages; so does no row."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    own = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "s", 0), (None, "the and of the and that it is with for", None, "s", 1), (902, "the and of it", "en", "s", 2), (902, "the and of it", "en", "s", 2)], own.schema)
    docs = own.unionByName(odd)
    for c in ("score", "predicted", "lang_pred", "kept", "n_bytes", "hash", "uid", "row"):
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        rows = docs.collect()
        assert rows and all(r.kept == f"kept {'-' if r.doc_id is None else r.doc_id}" and r.score.startswith("score ") and r.row.startswith("row ") for r in rows), name
        assert corpus_pipeline.written(stage(spark, docs.limit(0), SF)).count() == 0, name
    assert sum(r.doc_id == 902 for r in rows) == 1 and not any(r.doc_id in (900, 901) for r in rows)
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == len({r.doc_id for r in rows})
