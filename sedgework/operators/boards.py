"""Company boards with a cache, captures into a table of records, phrases that were used before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions import labels as L
from sedgework.functions import urls as U
from sedgework.functions import values as V
from sedgework.functions.dates import let
from sedgework.operators import records, search


def cached(boards: DataFrame, as_of: Column) -> DataFrame:
    """The boards that were written at most twelve hours ago."""
    return boards.where((F.unix_timestamp(as_of) - F.unix_timestamp("updated_at")).between(0, V.BOARD_TTL_HOURS * 3600))


def to_cache(postings: DataFrame, board: str, order: str, now: Column) -> DataFrame:
    """What a cache keeps of each board's postings: the first 300, without descriptions."""
    return records.cap_per_group(postings, F.col(board), order, V.CACHED_POSTINGS).drop("nth").withColumns({"description": F.lit(""), "updated_at": now})


def board_search(postings: DataFrame, keywords: list[str], exclude: list[str], score: Column, board: str, order: str, most: int = V.COMPANY_CAP) -> DataFrame:
    """Of each board the best postings: role filter (empty boards stay empty), excluded words unless they leave a board nothing, order by title, cap."""
    named = F.col("title"), F.col("departments")
    rows = postings.where(search.role_hit(*named, keywords))
    kept = F.lit(True)
    for word in exclude:
        kept = kept & ~search.haystack(*named).contains(word)
    some = F.max(kept).over(Window.partitionBy(board))
    rows = rows.withColumn("__kept", kept).withColumn("__some", some).where(F.col("__kept") | ~F.col("__some")).drop("__kept", "__some")
    return search.ordered_by_title(rows, score, board, order).where(F.col("nth") <= most)


def hydrated(survivors: DataFrame, texts: DataFrame) -> DataFrame:
    """Descriptions (id, text) for the postings that are left and have none."""
    both = survivors.join(texts.select("id", F.col("text").alias("__text")), "id", "left")
    return both.withColumn("description", F.when(F.coalesce("description", F.lit("")) == "", F.coalesce("__text", F.lit(""))).otherwise(F.col("description"))).drop("__text")


def capture_id(own: Column, url: Column) -> Column:
    """An input's id: its own, else one of its URL, else a new one."""
    return F.coalesce(F.when(own != "", own), L.url_id(url), F.uuid())


def captured(jobs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Inputs (id, title, url, status, notes, alias_urls) merged into jobs of the same columns; adds ``created``.

    Of an existing job status stays, and notes where it has any; both jobs' other URLs are united, each
    canonical one once, without the job's own. An id of several inputs takes the smallest row.
    """
    one = inputs.withColumn("id", capture_id(F.col("id"), F.col("url"))).groupBy("id").agg(F.min(F.struct("title", "url", "status", "notes", "alias_urls")).alias("n"))
    old = jobs.select("id", F.struct("title", "url", "status", "notes", "alias_urls").alias("o"))
    both = one.join(old, "id", "full")
    none = F.array().cast("array<string>")
    pick = lambda f: F.coalesce(f"n.{f}", f"o.{f}")
    every = F.concat(F.coalesce("o.alias_urls", none), F.coalesce("n.alias_urls", none))
    others = lambda own: F.filter(F.transform(every, lambda u: F.struct(u.alias("url"), U.canonical(u).alias("c"))), lambda x: x["c"].isNotNull() & ~F.coalesce(x["c"] == own, F.lit(False)))
    first = lambda xs, cs: F.transform(F.filter(xs, lambda x, i: F.array_position(cs, x["c"]) == i + 1), lambda x: x["url"])
    # a URL's canonical form is computed once
    united = let(U.canonical(F.col("n.url")), lambda own: let(others(own), lambda xs: let(F.transform(xs, lambda x: x["c"]), lambda cs: first(xs, cs))))
    changed = F.col("n").isNotNull()
    return both.select("id", pick("title").alias("title"), pick("url").alias("url"), F.coalesce("o.status", "n.status").alias("status"), F.coalesce("o.notes", "n.notes").alias("notes"), F.when(changed & F.col("o").isNotNull(), united).otherwise(pick("alias_urls")).alias("alias_urls"), (changed & F.col("o").isNull()).alias("created"))


def search_phrase(titles: Column, skills: Column) -> Column:
    """The first title, else the first three skills."""
    first = F.trim(F.get(titles, 0))
    return F.when(first != "", first).otherwise(F.trim(F.array_join(F.slice(skills, 1, 3), " ")))


def primary_keyword(titles: Column, skills: Column) -> Column:
    return F.trim(F.coalesce(F.get(skills, 0), F.get(titles, 0), F.lit("")))


def derived_title(text: Column) -> Column:
    """The first line that isn't blank, unless it is long."""
    first = F.get(F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != ""), 0)
    return F.when(F.length(first) <= V.DERIVED_TITLE_CHARS, first).otherwise("Untitled job")


def closed_host(url: Column) -> Column:
    """Which of the hosts that can't be read a URL is of; null if none."""
    host = F.regexp_replace(F.regexp_replace(url, "(?i)^[a-z]+://", ""), "[/?#:].*$", "")
    return F.coalesce(*[F.when(host.rlike(p), F.lit(name)) for name, p in V.CLOSED_HOSTS])


def strong_phrase(line: Column) -> Column:
    """The first two neighbouring content words behind the first word of a line; numbers and short words don't part them, small words do.

    A long line is read from its whole words near its start, and as a whole only if these have none.
    """
    start = F.regexp_replace(F.substring(line, 1, V.PHRASE_START), "\\S*$", "")
    return F.coalesce(F.when(F.length(line) > V.PHRASE_START, first_phrase(start)), first_phrase(line))


def first_phrase(line: Column) -> Column:
    bare = F.trim(line)
    for pattern in ("^[0-9]+[.)]\\s*", "^[•*-]\\s*", "^[*]+", "^[\"'`“‘]"):
        bare = F.regexp_replace(bare, pattern, "")
    # the whole line in a few passes, not its words one by one; no capital is left in lower case, so one marks what parts words
    rest = F.regexp_replace(F.lower(bare), "^\\S*\\s+", "")
    rest = F.regexp_replace(rest, f"(?<!\\S)(?:{'|'.join(V.PHRASE_STOPS)})(?!\\S)", "A")
    rest = F.regexp_replace(rest, "(?<!\\S)[$]?[0-9]\\S*", "")
    rest = F.regexp_replace(rest, "[^a-zA'\\s-]+", "")
    short = "(?:\\s+[a-z'-]{1,2}(?!\\S))*\\s+"
    found = F.regexp_extract(rest, f"([a-z'-]{{3,}}{short}[a-z'-]{{3,}})", 1)
    return F.nullif(F.regexp_replace(found, short, " "), F.lit(""))


def phrase_brief(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, phrases): the strong phrases of each group's lines, the last eight by their last use."""
    used = lines.select(key, order, F.explode(F.array(strong_phrase(F.col(line)))).alias("p")).where("p is not null").groupBy(key, "p").agg(F.max(order).alias("last"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("last")))
    kept = used.withColumn("nth", nth).where(F.col("nth") <= V.PHRASE_BRIEF)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("last", "p"))), lambda x: x["p"]), "; ").alias("phrases"))
