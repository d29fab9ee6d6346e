"""Values that the driver's tables do not hold (titles, places, dates, pay, feeds); ``dealt`` puts them beside the rows of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.sources.tables import table


def dealt(spark: SparkSession, sf: str, name: str, key: str, rows: list[tuple], names: str) -> DataFrame:
    """All rows of a table, with ``id`` (its key) and the values whose number is the key modulo their count."""
    pick = lambda k: F.element_at(F.array(*[F.lit(r[k]).cast("string") for r in rows]), (F.col(key) % len(rows) + 1).cast("int"))
    return table(spark, sf, name).withColumns({"id": F.col(key)} | {n.strip(): pick(k) for k, n in enumerate(names.split(",")) if k})


#: id, title, company, location, url, description, posted, pay
POSTINGS = [
    (1, "Senior Data Engineer", "Acme Inc.", "Berlin, Germany", "https://www.jobs.example.com/en-us/acme/1?utm_source=x&b=2&a=1#top", "We build a data pipeline on Spark.\n\nEqual opportunity employer\nWe celebrate everyone.\n\nRequirements: etl, machine learning", "2026-01-02", "$120,000 - $150,000 per year"),
    (2, "Senior Data Engineer", "ACME", "Berlin, Germany", "https://jobs.example.com/acme/1?a=1&b=2", "We build a data pipeline on Spark. Requirements: etl, machine learning", "2026-01-09", "$120K - $150K"),
    (3, "senior data-engineer", "Acme Corp", "Remote", "https://jobs.example.com/acme/3", "A data warehouse with a feature store and nlp", "2026-03-02", ""),
    (4, "Data Engineer, Platform", "Acme", "Munich", "https://jobs.example.com/acme/4", "A data warehouse with a feature store and nlp models", "2026-03-05", "$60 - $75 per hour"),
    (5, "Chief of Staff", "Globex LLC", "London", "https://globex.example.org/c/5?ref=mail", "Payments ledger, kyc and fraud detection. Apply now", None, "$9,000 to $11,000 a month"),
    (6, "VP Sales", "Globex", "Anywhere", "http://globex.example.org/c/6", "Enterprise SaaS crm with Salesforce sso", "2026-02-01", None),
    (7, "Jr. Game Developer", "Initech GmbH", "Paris, France", "https://initech.example.net/fr-FR/jobs/7?gclid=9", "Unreal engine, gameplay, multiplayer. Salary range: fair", "2026-02-11", "$40,000–$52,500 per year"),
    (8, "Staff Security Engineer", "Initech", "", "ftp://initech.example.net/8", "Zero trust, siem, incident response, penetration testing", "2026-02-12", "competitive"),
    (9, "Nurse", "Limited", "Madrid", None, None, "2026-02-13", "$30 - $35/hr"),
    (10, "", "Limited", "Madrid", "https://x.example.com/10", "Clinical patient care under hipaa with ehr", "2026-02-14", "$50k to $70k"),
]
POSTING_COLUMNS = "id bigint, title string, company string, location string, url string, description string, posted string, pay string"

#: Titles of every level, and some of none.
TITLES = [
    (1, "Co-Founder & CTO"), (2, "Chief Revenue Officer"), (3, "CEO"), (4, "SVP Engineering"), (5, "Executive Vice President"), (6, "Vice President, Data"),
    (7, "Head of Growth"), (8, "Engineering Manager"), (9, "Chief of Staff"), (10, "Staff Engineer"), (11, "Principal Scientist"), (12, "Tech Lead"),
    (13, "Senior Analyst"), (14, "Sr. Analyst"), (15, "Junior Designer"), (16, "Jr Designer"), (17, "Internship, Marketing"), (18, "Internal Auditor"), (19, "Leading Lady"), (20, ""),
]

DATES = [(1, "Jan 2020"), (2, "Sept. 2021"), (3, "3/2022"), (4, "2022/11"), (5, "2020-05"), (6, "13/2020"), (7, "Spring 2020"), (8, "  May 2019 "), (9, "2020"), (10, "2021/0")]
PLACES = [(1, "Austin, TX", "Austin, TX, USA"), (2, "Austin", "Remote (US)"), (3, "Paris", "London"), (4, "", "Berlin"), (5, "Berlin, DE", "berlin"), (6, "New York", "york"), (7, "Oslo", "Anywhere"), (8, "Rome", "")]
MARKDOWN = [(1, "# Title\nSee [docs](https://a.example/x \"t\") and **bold** `code` ![i](p.png)\n> quoted <me@a.example>"), (2, "plain\n[a]: https://one.example\n[A]: https://two.example\n[b]: <https://b.example>"), (3, "")]
ANSWERS = [(1, '{"a": 1}'), (2, '```json\n{"b": [1, 2], "a": "x"}\n```'), (3, 'Sure! {"ok": true} and more'), (4, "no json"), (5, "{broken {\"c\": null}"), (6, None)]
FEED_ROWS = [
    (1, "remotive", '{"id": 7, "title": " Data Engineer ", "company_name": "Acme", "candidate_required_location": "EU", "url": "https://a.example/7", "description": "<p>Hi &amp; bye</p>", "publication_date": "2026-01-05T10:00:00"}'),
    (2, "remotive", '{"id": 8, "title": "", "company_name": "Acme", "url": "https://a.example/8"}'),
    (3, "jobicy", '{"id": 9, "jobTitle": "Writer", "companyName": "Initech", "jobGeo": "Anywhere", "url": "https://j.example/9", "jobDescription": "<ul><li>One</li><li>Two</li></ul>", "pubDate": "2026-02-01 08:00:00"}'),
    (4, "jobicy", '{"id": 10, "jobTitle": "Writer", "url": "javascript:alert(1)"}'),
    (5, "arbeitnow", '{"slug": "dev-1", "title": "Developer", "company_name": "Globex", "location": "Berlin", "url": "http://g.example/1", "description": "x<br>y", "created_at": 1767225600}'),
    (6, "lever", '{"id": "u-1", "text": "Chef", "hostedUrl": "https://l.example/u-1", "descriptionPlain": "Cook", "createdAt": 1767225600000, "categories": {"location": "Lyon", "team": "Food"}}'),
    (7, "lever", "not json"),
]
PROFILES = [(1, "red widget"), (2, "small ring"), (3, "blue bolt"), (4, "widget"), (5, "large red widget")]
TERMS = [("the", 1.0), ("and", 1.0), ("les", 1.0), ("und", 1.0), ("para", 1.0), ("with", 0.5), ("dans", 0.5), ("sch", 0.5), ("que", 0.5), ("of", 0.5)]
MODELS, VARIANTS = [(1, "small"), (2, "medium"), (3, "large")], [(1, "baseline"), (2, "terse"), (3, "examples")]
