"""Search over postings: admission by terms, roles and excluded words, order by title, ratings in words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions import text as X
from sedgework.functions import values as V
from sedgework.operators import records


def query_terms(titles: list[str], skills: list[str], noise: tuple[str, ...] = ()) -> list[str]:
    """The terms that admit a posting: tokens of the wanted titles that aren't noise, and significant skills."""
    found: dict[str, None] = {}
    for title in titles:
        for token in re.split("[^a-z0-9+#.]+", title.lower()):
            token = token.strip(".")
            if len(token) >= V.LEAST_WORD and token not in V.QUERY_STOPWORDS and token not in noise:
                found[token] = None
    for skill in skills:
        term = skill.strip().lower()
        if term and term not in V.QUERY_STOPWORDS and (len(term) >= V.LEAST_WORD or re.search("[^a-z0-9]", term)):
            found[term] = None
    return list(found)


def matches_query(title: Column, description: Column, terms: list[str]) -> Column:
    """Whether a term stands in a posting; a query without terms admits all."""
    if not terms:
        return F.lit(True)
    any_ = "|".join(re.escape(t) for t in terms)
    return F.lower(F.concat_ws("\n", title, description)).rlike(f"(^|[^a-z0-9])({any_})($|[^a-z0-9])")


def haystack(title: Column, departments: Column) -> Column:
    return F.lower(F.concat_ws(" ", title, F.array_join(F.coalesce(departments, F.array().cast("array<string>")), " ")))


def role_hit(title: Column, departments: Column, keywords: list[str]) -> Column:
    """Whether a keyword is part of a title or department; no keywords: all."""
    if not keywords:
        return F.lit(True)
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: haystack(title, departments).contains(k))


def keep_unless_empty(df: DataFrame, keep: Column, mark: str) -> DataFrame:
    """The rows that a condition keeps; all, with ``mark`` true, where it would keep none. One flag row is joined back."""
    rows = df.withColumn("__keep", F.coalesce(keep, F.lit(False)))
    flag = rows.agg((F.count(F.when(F.col("__keep"), 1)) == 0).alias(mark))
    return rows.join(F.broadcast(flag), how="cross").where(F.col("__keep") | F.col(mark)).drop("__keep")


def refine(postings: DataFrame, keywords: list[str] | None, exclude: list[str]) -> DataFrame:
    """The role filter, then the excluded words, each left out where it would leave nothing."""
    named = F.col("title"), F.col("departments")
    out = postings.withColumn("role_suppressed", F.lit(False)) if keywords is None else keep_unless_empty(postings, role_hit(*named, keywords), "role_suppressed")
    return records.exclude_unless_empty(out, haystack(*named), exclude)


def drop_companies(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Without the postings whose id has one of some companies' keys before its colon."""
    return postings.where(~F.substring_index("id", ":", 1).isin(*keys) | ~F.col("id").contains(":")) if keys else postings


def title_words(text: Column) -> Column:
    """Distinct words of three letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[\\s/,&()-]+"), lambda w: F.length(w) >= V.LEAST_WORD))


def title_score(title: Column, departments: Column, titles: list[str], seniority: str | None, noise: tuple[str, ...] = ()) -> Column:
    """Ten points for each word of the wanted titles, and up to four for a near level."""
    if not titles:
        return F.lit(0).cast("bigint")
    wanted = sorted({w for t in titles for w in re.split("[\\s/,&()-]+", t.lower()) if len(w) >= V.LEAST_WORD} - {n.lower() for n in noise})
    overlap = F.size(F.array_intersect(title_words(haystack(title, departments)), F.array(*map(F.lit, wanted)).cast("array<string>")))
    level = V.SENIORITY_RUNGS.get(seniority or "")
    gap = F.abs(X.rung(X.seniority(title)) - F.lit(level)) if level is not None else F.lit(None)
    bonus = F.coalesce(F.greatest(F.lit(0), F.lit(V.LEVEL_POINTS) - gap), F.lit(0))
    return (overlap * V.TITLE_WORD_POINTS + bonus).cast("bigint")


def ordered_by_title(postings: DataFrame, score: Column, company: str, order: str) -> DataFrame:
    """``score`` and ``nth``, a posting's place within its company: by score, ties as they came."""
    return postings.withColumn("score", score).withColumn("nth", F.row_number().over(Window.partitionBy(company).orderBy(F.desc("score"), order)))


def specificity(terms: Column) -> Column:
    """How far a posting of so many terms is trusted."""
    return terms / (terms + F.lit(V.TERMS_HALF))


def banded(x: Column, bands: tuple) -> Column:
    out = F.when(x >= bands[0][0], F.lit(bands[0][1]))
    for least, phrase in bands[1:]:
        out = out.when(x >= least, F.lit(phrase))
    return out


def rating_phrases(fitness: Column, pay: Column, place: Column, level: Column, has_floor: Column) -> Column:
    """What is worth saying of a rating, in stars; axes without a value say nothing."""
    phrases = F.array(
        F.coalesce(banded(fitness, V.FIT_BANDS), F.lit("Weak fit")),
        F.when(has_floor, banded(pay, V.FLOOR_BANDS)).otherwise(banded(pay, V.PAY_BANDS)),
        F.when(place >= V.MAX_STARS, F.lit("Location match")),
        F.when(level >= V.LEVEL_MATCH, F.lit("Level match")).when(level < V.LEVEL_GAP, F.lit("Level gap")),
    )
    return F.filter(phrases, lambda p: p.isNotNull())


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the shared beginning of two texts."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.array_max(same)


def loosely_equal(a: Column, b: Column) -> Column:
    """Equal, or of one stem of four letters with at most four more on both sides."""
    stem = common_prefix(a, b)
    near = (stem >= V.STEM_CHARS) & (F.length(a) - stem <= V.STEM_REST) & (F.length(b) - stem <= V.STEM_REST)
    return (a == b) | near


def role_tokens(text: Column) -> Column:
    """Words of a skill or title that say what a role does."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9+#]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*V.LEVEL_WORDS)))


def relevance(skill: Column, title: Column) -> Column:
    """Two points for each token of a skill that a title has, one for each that it has a near form of."""
    wanted = role_tokens(title)
    point = lambda t: F.when(F.array_contains(wanted, t), 2).when(F.exists(wanted, lambda w: loosely_equal(t, w)), 1).otherwise(0)
    return F.aggregate(F.transform(role_tokens(skill), point), F.lit(0), lambda a, p: a + p)


def without_operators(phrase: Column) -> Column:
    """A search phrase without minus signs before its words."""
    return F.array_join(F.filter(F.transform(F.split(phrase, "\\s+"), lambda t: F.regexp_replace(t, "^-+", "")), lambda t: t != ""), " ")


def search_keywords(seniority: Column, titles: Column, skills: Column) -> Column:
    """Level (unless a title has it), titles and the first six skills as one phrase."""
    doubled = F.exists(titles, lambda t: F.lower(t).contains(F.lower(seniority)))
    parts = F.concat(F.array(F.when(~doubled, seniority)), titles, F.slice(skills, 1, V.LINK_SKILLS))
    return without_operators(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (F.trim(p) != "")), " "))


def form_encoded(text: Column) -> Column:
    """A value of a query string: blanks as plus signs."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("%7E")), F.lit("%20"), F.lit("+"))


def deep_links(keywords: Column, place: Column) -> Column:
    """Array of (label, url) of the search pages of three boards."""
    where = F.substring(F.trim(F.coalesce(place, F.lit(""))), 1, V.LINK_PLACE_CHARS)
    pair = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}="), form_encoded(value)))
    link = lambda label, base, *pairs: F.struct(F.lit(label).alias("label"), F.concat(F.lit(base), F.concat_ws("&", *pairs)).alias("url"))
    general = F.when(keywords != "", F.concat(keywords, F.lit(" jobs"))).otherwise("jobs")
    return F.array(
        link("LinkedIn", "https://www.linkedin.com/jobs/search/?", pair("keywords", keywords), pair("location", where)),
        link("Indeed", "https://www.indeed.com/jobs?", pair("q", keywords), pair("l", where)),
        link("Google Jobs", "https://www.google.com/search?", pair("q", general)),
    )


def adherence(bullets: DataFrame, key: str, word: str, most_words: int) -> DataFrame:
    """Of each group's lines: is a word absent, is each short enough, does each begin with another action verb."""
    first = F.regexp_replace(F.lower(F.element_at(F.split(F.col("bullet"), "\\s"), 1)), "[^a-z]", "")
    return bullets.groupBy(key).agg(
        (~F.bool_or(F.lower("bullet").rlike(f"{X.START}{re.escape(word.lower())}{X.END}"))).alias("word_absent"),
        F.bool_and(X.count_words(F.col("bullet")) <= most_words).alias("short_enough"),
        (F.bool_and(X.starts_with_verb(F.col("bullet"))) & (F.count_distinct(first) == F.count("*"))).alias("verbs_differ"),
    )


def escalation(scanned: Column, two_columns: Column, hard_reasons: Column, confidence: Column) -> Column:
    """Which further pass a parse needs."""
    weak = (hard_reasons > 0) | F.coalesce(confidence < V.ESCALATION_CONFIDENCE, F.lit(False))
    return F.when(scanned, "ocr").when(two_columns, "ner").when(weak, "llm").otherwise("none")


def contact_rows(records_: DataFrame, key: str) -> DataFrame:
    """The rows of each record's contact card: (key, ord, field, label, value, gated, reason).

    A record has one column for each field and one ``<field>_conf`` for its confidence. A field that may
    be missing has a row only where it is trusted; a trusted code profile stands in for the professional one.
    """
    trusted = lambda f: (F.coalesce(F.col(f), F.lit("")) != "") & (F.coalesce(F.col(f"{f}_conf"), F.lit(0.0)) >= V.CONTACT_FLOOR)
    rows = []
    for i, (f, label, optional) in enumerate(V.CONTACT_ROWS):
        value = F.coalesce(F.col(f), F.lit(""))
        shown = trusted(f) if optional else trusted(f) | ~trusted("github_url") if f == "linkedin_url" else F.lit(True)
        reason = F.when(value == "", "absent").when(~trusted(f), "low_confidence")
        rows.append(F.when(shown, F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.lit(label).alias("label"), value.alias("value"), reason.isNotNull().alias("gated"), reason.alias("reason"))))
    return records_.select(key, F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select(key, "r.*")


def contact_gate(rows: DataFrame, key: str, has_entries: DataFrame) -> DataFrame:
    """Of each record's rows: how many are found, of how many, what blocks its download, and whether its score is shown.

    ``has_entries`` holds the keys of the records that have an entry.
    """
    gated = lambda f: F.coalesce(F.bool_or(F.when(F.col("field") == f, F.col("gated"))), F.lit(True))
    a = rows.groupBy(key).agg(F.count(F.when(~F.col("gated"), 1)).alias("detected"), F.count("*").alias("total"), gated("full_name").alias("name"), (gated("email") & gated("phone")).alias("contact"))
    a = a.join(has_entries.select(key).distinct().withColumn("entries", F.lit(True)), key, "left")
    missing = F.array_compact(F.array(F.when(F.col("name"), "full_name"), F.when(F.col("contact"), "contact"), F.when(F.col("entries").isNull(), "experience")))
    return a.select(key, "detected", "total", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("revealed"))
