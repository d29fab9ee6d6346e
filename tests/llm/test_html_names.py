"""What names of elements may decide against what varies over a host's pages."""

from __future__ import annotations

from sedgework.llm import html_wrapper as hw

S = hw.Settings()


def page(*blocks: str) -> str:
    return "<html><body><nav>Home</nav>" + "".join(blocks) + "</body></html>"


def texts(pages: list[str]) -> list[str]:
    wrapper = hw.induce(pages, S)
    return [hw.extract(p, wrapper) for p in pages]


def words(k: int, n: int, what: str) -> str:
    return " ".join(f"{what}{k}x{i}" for i in range(n))


def test_varying_slots_stay_whatever_they_are_called():
    pages = [page(f"<div class='social-policy-report'><p>{words(k, 40, 'report')}</p></div>", f"<div class='related'><p>{words(k, 38, 'more')}</p></div>") for k in range(4)]
    assert texts(pages) == [f"{words(k, 40, 'report')}\n\n{words(k, 38, 'more')}" for k in range(4)]


def test_small_named_slots_and_comments_go():
    body = lambda k: f"<div class='text'><p>{words(k, 60, 'body')}</p><p>{words(k, 30, 'rest')}</p></div>"
    pages = [page(body(k), f"<div class='sidebar'>{words(k, 6, 'side')}</div>", f"<div class='comments'><p>{words(k, 80, 'said')}</p></div>") for k in range(5)]
    assert texts(pages) == [f"{words(k, 60, 'body')}\n\n{words(k, 30, 'rest')}" for k in range(5)]


def test_names_hold_beside_an_article():
    pages = [page(f"<article><h1>{words(k, 3, 'head')}</h1><p>{words(k, 30, 'body')}</p></article>", f"<div class='related'><p>{words(k, 60, 'other')}</p></div>") for k in range(4)]
    assert texts(pages) == [f"{words(k, 3, 'head')}\n\n{words(k, 30, 'body')}" for k in range(4)]


def test_text_that_is_only_in_named_slots_stays():
    pages = [page(f"<div class='comments'><p>{words(k, 20, 'said')}</p></div>") for k in range(4)]
    assert texts(pages) == [words(k, 20, "said") for k in range(4)]


def test_pages_that_are_all_template():
    """None of three pages without an article that say the same; the article, where there is one; a page alone keeps all."""
    same = [f"<html><script>x={k}</script><body><div><p>One constant text</p></div></body></html>" for k in range(3)]
    assert texts(same) == [""] * 3
    assert texts([s.replace("<div>", "<article>").replace("</div>", "</article>") for s in same]) == ["One constant text"] * 3
    assert texts(same[:1]) == ["One constant text"] and hw.extract(same[0], None) == "One constant text"


def test_a_notice_on_few_pages_is_learned_from_all(spark):
    """One page in twenty has a notice beside its article, far from what a sample of a dozen pages shows; a lead of one page stays, so do copies of it."""
    rows = []
    for k in range(400):
        note = "<div><p>Our office is closed on Friday, see the plan</p></div>" if k % 20 == 3 else ""
        rows.append((k, "https://a.org/x", page(note, f"<div><p>{words(k, 5, 'lead')}</p></div><article><p>{words(k, 20, 'body')}</p></article>")))
    rows += [(1000 + k, "https://a.org/x", rows[7][2]) for k in range(60)]
    got = {r.page_id: r.text for r in hw.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(400):
        assert got[k] == f"{words(k, 5, 'lead')}\n\n{words(k, 20, 'body')}", k
    assert all(got[1000 + k] == got[7] for k in range(60))
