"""Pages of postings as trees: what is not the posting is cut, and what the page says about itself is read.

Works on the table of ``sources.html.nodes``: a subtree is a range of nodes, so "is inside of" is a running maximum of ends, and no
page is ever joined with itself. A page is the unit of every window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions import dates as T
from sedgework.functions import values as V

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (text.rlike(f"(?i){p}") for p in patterns)), F.lit(False))


def inside(nodes: DataFrame, key: str, top: Column, name: str) -> DataFrame:
    """Add whether a node lies in the subtree of one that ``top`` names, or is one."""
    order = Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn(name, F.coalesce(F.max(F.when(top, F.col("last"))).over(order) >= F.col("node"), F.lit(False)))


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def subtree_texts(nodes: DataFrame, key: str, tops: Column) -> DataFrame:
    """(key, node, said): the text below each of some nodes that don't hold one another."""
    order = Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(F.when(tops, F.struct("node", "last"))).over(order)
    rows = nodes.withColumn("__t", top).where((F.col("__t.last") >= F.col("node")) & F.col("text").isNotNull())
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "text"))), lambda s: s["text"]), "")
    return rows.groupBy(key, F.col("__t.node").alias("top")).agg(said.alias("said")).select(key, F.col("top").alias("node"), "said")


def pruned(nodes: DataFrame, key: str) -> DataFrame:
    """The nodes of a page (or of the element that was parsed) that belong to the posting.

    Navigation, asides, footers, forms and scripts go; then a block under a caption that announces people, other postings or a feed (the
    largest block that begins with this heading, else the heading and what follows it up to the next); then lists whose items are
    all cards of other postings: dominated by a link to one, that is not inside of running text. All is judged on the page as it is.
    """
    part = Window.partitionBy(key)
    order = part.orderBy("node")
    after = order.rowsBetween(0, Window.unboundedFollowing)
    rows = inside(nodes, key, F.col("tag").isin(*V.NON_POSTING_TAGS), "__out").where(~F.col("__out")).drop("__out")
    root = F.min(F.when(F.col("tag") == "body", F.col("depth"))).over(part)
    rows = rows.withColumn("__root", F.coalesce(root, F.lit(0)))
    heads = subtree_texts(rows, key, F.col("tag").isin(*HEADINGS)).select(key, "node", any_of(one_space(F.col("said")), V.NON_POSTING_CAPTIONS).alias("__bad"))
    rows = rows.join(heads, [key, "node"], "left")
    heading = F.col("tag").isin(*HEADINGS)
    # the first heading at or below a node: the largest node of a bad first heading is its block
    rows = rows.withColumn("__first", F.min(F.when(heading, F.struct("node", F.coalesce("__bad", F.lit(False)).alias("bad")))).over(after))
    holds = (F.col("text").isNull()) & (F.col("__first.node") <= F.col("last")) & F.col("__first.bad") & (F.col("depth") > F.col("__root"))
    rows = rows.withColumn("__block", F.min(F.when(holds, F.col("node"))).over(Window.partitionBy(key, F.when(holds, F.col("__first.node")))) == F.col("node"))
    rows = rows.withColumn("__block", F.coalesce(holds & F.col("__block"), F.lit(False)))
    # a caption that is its own block takes its next siblings along, up to a heading
    siblings = Window.partitionBy(key, "parent").orderBy("node")
    lone = F.col("__block") & heading
    state = F.when(heading, lone)
    rows = rows.withColumn("__run", F.coalesce(F.last(state, ignorenulls=True).over(siblings.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)) & F.col("text").isNull())
    rows = inside(rows, key, F.col("__block") | F.col("__run"), "__out").where(~F.col("__out")).drop("__out", "__bad", "__first", "__block", "__run", "__root")
    return without_rails(rows, key)


def without_rails(rows: DataFrame, key: str) -> DataFrame:
    """Nodes but for those of lists of other postings."""
    chars = lambda said: F.length(one_space(said))
    part = Window.partitionBy(key)
    # only pages with a link to a posting can have a rail
    permalink = (F.col("tag") == "a") & any_of(F.try_element_at("attrs", F.lit("href")), V.POSTING_LINKS)
    rows = rows.withColumn("__may", F.max(permalink).over(part))
    some = rows.where("__may")
    # each text's characters count for the nearest item and, if it is in a link, for that link; nested items count for those around them too
    items = some.where("tag = 'li'").select(key, F.col("node").alias("item"), F.col("last").alias("item_last"), F.col("parent").alias("list"))
    links = some.where("tag = 'a' AND map_contains_key(attrs, 'href')").select(key, F.col("node").alias("link"), F.col("last").alias("link_last"), permalink.alias("posting"), F.col("depth").alias("link_depth"))
    texts = some.where("text is not null").select(key, F.col("node").alias("t"), F.col("parent").alias("t_parent"), "text")
    within = lambda a, b, end: (F.col(a) >= F.col(b)) & (F.col(a) <= F.col(end))
    item_text = items.join(texts, key).where(within("t", "item", "item_last")).groupBy(key, "item", "list").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "text"))), lambda s: s["text"]), "").alias("said"))
    # a link's own item is the innermost one around it; it is in running text where an element between has words of its own beside it
    own = links.join(items, key).where(within("link", "item", "item_last")).groupBy(key, "link", "link_last", "posting").agg(F.max(F.struct("item", "item_last")).alias("i")).select(key, "link", "link_last", "posting", "i.*")
    spoken = some.where("text is not null AND trim(text) <> ''").select(key, F.col("parent").alias("speaker")).distinct().join(some.select(key, F.col("node").alias("speaker"), F.col("last").alias("speaker_last")), [key, "speaker"])
    prose = own.join(spoken, key).where(within("link", "speaker", "speaker_last") & (F.col("speaker") != F.col("link")) & (F.col("speaker") >= F.col("item"))).select(key, "link").distinct()
    own = own.join(prose, [key, "link"], "left_anti")
    link_text = own.join(texts, key, "left").where(F.col("t").isNull() | within("t", "link", "link_last")).groupBy(key, "item", "link").agg(F.max("posting").alias("posting"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "text"))), lambda s: s["text"]), "").alias("said"))
    per_item = link_text.groupBy(key, "item").agg(F.max("posting").alias("posting"), F.sum(chars(F.col("said"))).alias("linked"))
    cards = items.select(key, "item", "list").join(item_text.select(key, "item", "said"), [key, "item"], "left").join(per_item, [key, "item"], "left")
    card = F.coalesce(F.col("posting"), F.lit(False)) & (chars(F.coalesce("said", F.lit(""))) - F.coalesce("linked", F.lit(0)) <= V.CARD_TEXT)
    rails = cards.groupBy(key, "list").agg(F.count("*").alias("n"), F.bool_and(card).alias("all")).where((F.col("n") >= V.RAIL_ITEMS) & F.col("all"))
    marked = rows.join(rails.select(key, F.col("list").alias("node"), F.lit(True).alias("__rail")), [key, "node"], "left")
    rail = F.coalesce("__rail", F.lit(False)) & F.col("tag").isin("ul", "ol")
    return inside(marked, key, rail, "__out").where(~F.col("__out")).drop("__out", "__rail", "__may")


def texts(nodes: DataFrame, key: str) -> DataFrame:
    """(key, text): the texts of a page's nodes in order, blanks between them as one."""
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("node", "text")))), lambda s: s["text"]), " ")
    return nodes.groupBy(key).agg(one_space(said).alias("text"))


def platform(address: Column) -> Column:
    """The application system that an address names; null if none."""
    low = F.lower(address)
    return F.coalesce(*[F.when(low.contains(host), F.lit(name)) for host, name in V.ATS_HOSTS])


def metadata(nodes: DataFrame, addresses: DataFrame, key: str) -> DataFrame:
    """(key, title, company, location, preview, job_id, platform, apply_url) as the page's own marks say.

    Title, site and description come from its ``og:`` properties, the title also from a job element's data or the first h1; the id from metas or
    that element; the system from the first link to apply, then from the page's address (``addresses``: key, url). ``apply_url`` is the first
    link that says apply and leaves the page's host. What isn't there is null.
    """
    attr = lambda name: T.some(F.try_element_at("attrs", F.lit(name)))
    first = lambda when, value: F.min(F.when(when & value.isNotNull(), F.struct("node", value.alias("v"))))["v"]
    meta = lambda by, name: first((F.col("tag") == "meta") & (F.try_element_at("attrs", F.lit(by)) == name), attr("content"))
    has = lambda name: F.map_contains_key("attrs", F.lit(name))
    cls = F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit(""))
    href = F.coalesce(attr("href"), F.lit(""))
    job = has("data-jobtitle") | has("data-job-title") | (has("data-id") & cls.contains("job"))
    held = F.struct(F.coalesce(attr("data-jobtitle"), attr("data-job-title")).alias("title"), attr("data-id").alias("id"), F.coalesce(attr("data-location"), attr("data-job-location")).alias("place"))
    apply_link = ((F.col("tag") == "a") & (href.contains("apply") | cls.contains("apply"))) | has("data-apply-url")
    marks = nodes.where(F.col("text").isNull()).groupBy(key).agg(
        meta("property", "og:title").alias("og_title"), meta("property", "og:site_name").alias("company"), meta("property", "og:description").alias("og_text"),
        F.coalesce(*[meta("name", n) for n in V.JOB_ID_METAS]).alias("meta_id"), F.min(F.when(job, F.struct("node", held.alias("v"))))["v"].alias("job"),
        first(apply_link, platform(F.coalesce(T.some(href), attr("data-apply-url")))).alias("linked"),
    )
    heads = subtree_texts(nodes, key, F.col("tag") == "h1").groupBy(key).agg(F.min(F.struct("node", one_space(F.col("said")).alias("v")))["v"].alias("h1"))
    pages = addresses.select(key, "url").dropDuplicates([key])
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z]+://([^/?#:]*)", 1))
    links = nodes.where("tag = 'a'").select(key, "node", href.alias("href"))
    said = subtree_texts(nodes, key, F.col("tag") == "a").where(F.col("said").rlike("(?i)apply"))
    away = links.join(said, [key, "node"]).join(pages.select(key, host.alias("host")), key).withColumn("to", F.lower(F.regexp_extract("href", "(?i)^https?://([^/?#:]*)", 1)))
    away = away.where((F.col("to") != "") & ((F.col("host") == "") | ~F.col("to").contains(F.col("host")))).groupBy(key).agg(F.min(F.struct("node", "href"))["href"].alias("apply_url"))
    found = pages.join(marks, key, "left").join(heads, key, "left").join(away, key, "left")
    return found.select(
        key, F.coalesce("og_title", "job.title", T.some(F.col("h1"))).alias("title"), "company", F.col("job.place").alias("location"), F.substring("og_text", 1, V.PREVIEW_CHARS).alias("preview"),
        F.coalesce("meta_id", "job.id").alias("job_id"), F.coalesce("linked", platform(F.coalesce("url", F.lit("")))).alias("platform"), "apply_url",
    )
