"""Pages as trees: nodes, what is cut of a posting's page, what it says of itself; golden pages in one run."""

from __future__ import annotations

import pytest

from sedgework.operators import pages as P
from sedgework.sources import html as H

PAGES = {
    "plain": ("<h1>Engineer</h1><p>We build.<ul><li>SQL<li>Python</ul>", "Engineer We build. SQL Python"),
    "tags": ("<body><nav>Home</nav><main>Job<script>x()</script><style>p{}</style><form>Search</form></main><aside>Ad</aside><footer>End</footer></body>", "Job"),
    "people": ("<body><main><h1>Engineer</h1><p>We build.</p><section><div><h2>People you can reach out to</h2></div><p>Jane Doe, Acme</p></section><p>Apply soon</p></main></body>", "Engineer We build. Apply soon"),
    "run": ("<body><main><h1>Engineer</h1><h3>Similar Jobs</h3><p>Analyst</p><div>Clerk</div><h3>Pay</h3><p>Good</p></main></body>", "Engineer Pay Good"),
    "rail": ("<body><main><ul>" + "".join(f"<li><div><a href='/jobs/view/{k}'>Analyst {k}</a></div><span>Acme</span></li>" for k in range(3)) + "</ul><p>Engineer wanted</p></main></body>", "Engineer wanted"),
    "one bare item": ("<ul><li><a href='/jobs/view/1'>Analyst</a></li><li>Five years of SQL</li></ul>", "Analyst Five years of SQL"),
    "prose links": ("<ul>" + "<li>You will work beside the <a href='/jobs/view/7'>analyst</a> every day</li>" * 2 + "</ul>", "You will work beside the analyst every day You will work beside the analyst every day"),
    "long cards": ("<ul>" + ("<li><a href='/jobs/view/7'>analyst</a><p>" + "word " * 40 + "</p></li>") * 2 + "</ul>", " ".join(["analyst " + "word " * 39 + "word"] * 2)),
    "nested": ("<ul><li>Duties<ul><li><a href='/jobs/view/1'>A</a></li><li><a href='?currentJobId=2'>B</a></li></ul></li><li>Pay</li></ul>", "Duties Pay"),
    "empty": ("", None),
    "null": (None, None),
    "text": ("just words", "just words"),
}


@pytest.fixture(scope="module")
def nodes(spark):
    return H.nodes(spark.createDataFrame([(k, v[0]) for k, v in PAGES.items()], "page string, html string"), "page").cache()


def test_subtrees_are_ranges(nodes):
    for page in PAGES:
        rows = sorted([r for r in nodes.where(nodes.page == page).collect()], key=lambda r: r.node)
        assert [r.node for r in rows] == list(range(len(rows)))
        for r in rows:
            below = {r.node}
            for x in rows[r.node + 1 :]:
                if x.parent in below:
                    below.add(x.node)
            assert below == set(range(r.node, r.last + 1))
    assert [r.tag for r in nodes.where("page = 'plain' AND text IS NULL").orderBy("node").collect()] == ["h1", "p", "ul", "li", "li"]


def test_what_is_not_the_posting_is_cut(nodes):
    got = {r.page: r.text for r in P.texts(P.pruned(nodes, "page"), "page").collect()}
    assert got == {k: v[1] for k, v in PAGES.items() if v[1] is not None}


META = {
    "og": ("<meta property='og:title' content='Engineer'><meta property='og:site_name' content='Acme'><meta property='og:description' content='" + "d" * 300 + "'><meta name='jobId' content='7'><h1>Other</h1>", "https://acme.org/jobs/1", ("Engineer", "Acme", None, "d" * 200, "7", None, None)),
    "data": ("<div class='job-detail' data-id='9' data-job-title='Analyst' data-location='Berlin'></div><a href='https://boards.greenhouse.io/acme/9/apply'>Apply now</a>", "https://x.org", ("Analyst", None, "Berlin", None, "9", "Greenhouse", "https://boards.greenhouse.io/acme/9/apply")),
    "h1": ("<h1> A <b>Clerk</b> </h1><a href='https://jobs.x.org/apply'>apply</a><a href='mailto:x'>Apply</a>", "https://x.org", ("A Clerk", None, None, None, None, None, None)),
    "address": ("<p>nothing</p>", "https://acme.wd5.myworkdayjobs.com/9", (None, None, None, None, None, "Workday", None)),
    "null": (None, None, (None,) * 7),
}


def test_what_pages_say_of_themselves(spark):
    pages = spark.createDataFrame([(k, v[0], v[1]) for k, v in META.items()], "page string, html string, url string")
    got = {r.page: tuple(r)[1:] for r in P.metadata(H.nodes(pages, "page"), pages, "page").collect()}
    assert got == {k: v[2] for k, v in META.items()}
