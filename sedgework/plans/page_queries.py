"""Queries over pages as trees: all pages, with captions, rails of links and marks of postings put in by expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.operators import pages as P
from sedgework.plans.registry import Registry
from sedgework.sources import html as H
from sedgework.sources.tables import table

R = Registry()

RAIL = "<ul><li><a href='/jobs/view/1'>Analyst</a> <span>Acme</span></li><li><div><a href='/jobs/view/2'>Clerk</a></div></li></ul>"
CAPTION = "<section><h2>Similar jobs</h2><p>Analyst</p></section>"


def posting_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, url, html): every third page has a caption, every fourth a rail, every fifth marks in its head."""
    n, lit = F.col("page_id"), F.lit
    body = F.concat(F.when(n % 3 == 0, CAPTION).otherwise(""), F.when(n % 4 == 0, RAIL).otherwise(""), lit("</article>"))
    head = F.concat(lit("<meta property='og:title' content='Role "), n, lit("'><meta property='og:site_name' content='Firm'><meta name='jobId' content='"), n, lit("'></head>"))
    link = F.when(n % 7 == 0, "<a href='https://jobs.lever.co/firm/apply'>Apply here</a></body>").otherwise("</body>")
    html = F.replace(F.replace(F.col("html"), lit("</article>"), body), lit("</body>"), link)
    return table(spark, sf, "pages").select("page_id", "url", F.when(n % 5 == 0, F.replace(html, lit("</head>"), head)).otherwise(html).alias("html"))


@R.query()
def pruned_pages(spark, sf):
    """What each page says of its posting, without navigation, captions of other blocks and rails of other postings."""
    return P.texts(P.pruned(H.nodes(posting_pages(spark, sf), "page_id"), "page_id"), "page_id")


@R.query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'Role ' || page_id END AS og_title, CASE WHEN page_id % 5 = 0 THEN 'Firm' END AS company, CASE WHEN page_id % 5 = 0 THEN page_id || '' END AS job_id,
  CASE WHEN page_id % 7 = 0 AND contains(html, '</body>') THEN 'Lever' END AS platform, CASE WHEN page_id % 7 = 0 AND contains(html, '</body>') THEN 'https://jobs.lever.co/firm/apply' END AS apply_url FROM pages""")
def page_metadata(spark, sf):
    """Title, firm, id, system and link to apply of each page."""
    pages = posting_pages(spark, sf)
    found = P.metadata(H.nodes(pages, "page_id"), pages, "page_id")
    return found.select("page_id", F.when(F.col("company").isNotNull(), F.col("title")).alias("og_title"), "company", "job_id", "platform", "apply_url")
