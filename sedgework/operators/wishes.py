"""What a search is built from: titles, skills and noise of a record; its profiles on the web."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgework.functions import dates as T
from sedgework.functions import shapes as H
from sedgework.functions import urls as U
from sedgework.functions import values as V
from sedgework.operators import search


def parts_of(headline: Column) -> Column:
    """The parts of a headline between dots, bars and spaced dashes."""
    return F.filter(F.transform(F.split(F.trim(headline), "[·•|]|\\s[-–—/]\\s"), lambda p: F.trim(p)), lambda p: p != "")


def split_headline(headline: Column) -> Column:
    """The parts that read like titles; the whole where none of several does."""
    parts = parts_of(F.coalesce(headline, F.lit("")))
    titled = F.filter(parts, H.looks_like_title)
    return F.when(F.size(parts) <= 1, parts).when(F.size(titled) > 0, titled).otherwise(F.array(F.trim(headline)))


def role_head(title: Column) -> Column:
    """The first part of a title that reads like one, else all of it."""
    parts = parts_of(title)
    return F.when(F.size(parts) > 1, F.coalesce(F.get(F.filter(parts, H.looks_like_title), 0), F.trim(title))).otherwise(F.trim(title))


def first_of_each(items: Column, key) -> Column:
    """An array without later members of an equal key."""
    first = lambda xs, keys: F.filter(xs, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return T.let(items, lambda xs: T.let(F.transform(xs, key), lambda keys: first(xs, keys)))


def wanted_titles(headline: Column, titles: Column) -> Column:
    """Up to four titles: the headline's, then the others, each once in any case."""
    both = F.filter(F.transform(F.concat(split_headline(headline), titles), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    return F.slice(first_of_each(both, lambda t: F.lower(t)), 1, V.MOST_TITLES)


def wanted_skills(listed: Column, labels: dict[str, str]) -> Column:
    """Up to twelve skills, those of the dictionary (alias in lower case to label) first, each once; others with capitals."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    clean = F.filter(F.transform(listed, lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))
    label = lambda s: F.element_at(known, F.lower(s))
    capital = lambda s: F.array_join(F.transform(F.split(s, "\\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")
    each = first_of_each(clean, lambda s: F.coalesce(label(s), F.lower(s)))
    named = F.transform(each, lambda s: F.struct(label(s).isNotNull().alias("known"), F.coalesce(label(s), capital(s)).alias("label")))
    names = lambda hit: F.transform(F.filter(named, lambda x: x["known"] == hit), lambda x: x["label"])
    return F.slice(F.concat(names(True), names(False)), 1, V.MOST_SKILLS)


def title_noise(places: Column, companies: Column, vocabulary: list[str]) -> Column:
    """Words of places and employers that name no role."""
    words = F.flatten(F.transform(F.filter(F.concat(places, companies), lambda x: x.isNotNull()), search.title_words))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*vocabulary)))


def skill_words(raw: Column) -> Column:
    return F.filter(F.split(F.lower(raw), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*V.SKILL_STOPS))


def skill_covers(expected: Column, skill: Column, less: bool = False) -> Column:
    """Whether a skill says an expected one: some concept of it has all its words; with ``less``, or has its last word and no other."""
    want = skill_words(expected)
    concepts = F.transform(F.split(skill, "(?i)\\s*(?:&|/|,|\\band\\b)\\s*"), skill_words)
    has = lambda small, big: F.size(F.array_except(small, big)) == 0
    full = F.exists(concepts, lambda c: (F.size(c) > 0) & has(want, c))
    loose = F.exists(concepts, lambda c: F.array_contains(c, F.element_at(want, -1)) & has(c, want)) if less else F.lit(False)
    return (F.size(want) > 0) & (full | F.when(F.size(want) > 1, loose).otherwise(False))


def profile(url: Column) -> Column:
    """Struct of url, network and kind of a link; null if it is none. Pages of a network that are no profile are other links of its host."""
    return T.let(H.full_url(url), lambda full: T.let(_bare_host(full), lambda host: _profile(full, host)))


def _bare_host(full: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(full, "(?i)^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1), "(?i)^www[.]", ""))


def _profile(full: Column, host: Column) -> Column:
    hits = [host.rlike(p) & ~(full.rlike(V.LINKEDIN_OTHER) if name == "LinkedIn" else F.lit(False)) for p, name, _ in V.PROFILE_HOSTS]
    which = F.coalesce(*[F.when(h, F.struct(F.lit(name).alias("network"), F.lit(k).alias("kind"))) for h, (_, name, k) in zip(hits, V.PROFILE_HOSTS, strict=True)], F.struct(host.alias("network"), F.lit("other").alias("kind")))
    shown = T.let(which, lambda w: F.struct(full.alias("url"), w["network"].alias("network"), w["kind"].alias("kind")))
    return F.when(full.isNotNull() & (host.contains(".") | (host == "localhost")), shown)


def profiles(urls: Column) -> Column:
    """The profiles of links, each address once."""
    found = F.filter(F.transform(urls, profile), lambda p: p.isNotNull())
    return first_of_each(found, lambda p: U.slug(p["url"]))


def contact_profiles(legacy: Column, more: Column) -> Column:
    """The links of the old fields first, then other profiles whose address isn't there yet."""
    return profiles(F.concat(F.filter(legacy, lambda u: T.some(u).isNotNull()), more))
