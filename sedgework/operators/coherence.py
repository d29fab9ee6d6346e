"""Judging a search against profiles of roles: which terms help, which are missing, and whether titles and skills are of one side.

Profiles are a table (profile, family, titles, skills). Titles resolve by containment of tokens and skills by votes, both through inverted
indexes; each search keeps a handful of profiles, and all further judgement is on its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions import text as X
from sedgework.functions import values as V
from sedgework.operators.matching import contained_profiles, profile_votes
from sedgework.operators.wishes import skill_covers

PROFILE = "array<struct<profile:int,family:string,titles:array<string>,skills:array<string>>>"
NONE = "array<string>"


def skill_key(skill: Column) -> Column:
    return F.regexp_replace(F.lower(skill), "[^a-z0-9]", "")


def says(expected: Column, title: Column) -> Column:
    """Whether a title has all tokens of an expected one."""
    want = X.title_tokens(expected)
    return (F.size(want) > 0) & (F.size(F.array_except(want, X.title_tokens(title))) == 0)


def resolved(queries: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """(key, by_titles, by_skills): the profiles that a search's titles and its skills speak for, best first, five at most."""
    names = profiles.select("profile", F.posexplode("titles").alias("k", "name"))
    each = queries.select(key, F.posexplode("titles").alias("i", "title"))
    pairs = contained_profiles(each.select(F.struct(key, "i").alias("title_id"), "title"), names.select(F.struct("profile", "k").alias("profile"), "name"))
    titles = pairs.groupBy(F.col(f"title_id.{key}").alias(key), F.col("profile.profile").alias("profile")).agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "profile"))
    titles = titles.withColumn("place", nth).where(F.col("place") <= V.RESOLVED_PROFILES).select(key, "profile", "place")
    wanted = profiles.select("profile", F.posexplode("skills").alias("rank", "skill"))
    votes = profile_votes(queries.select(F.col(key).alias("owner"), F.explode("skills").alias("skill")), wanted, top=V.RESOLVED_PROFILES).select(F.col("owner").alias(key), "profile", "place")

    def listed(found: DataFrame, name: str) -> DataFrame:
        whole = found.join(profiles.select("profile", "family", "titles", "skills"), "profile")
        rows = whole.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", F.struct(F.col("profile").cast("int").alias("profile"), "family", "titles", "skills").alias("p")))).alias("a"))
        return rows.select(key, F.transform("a", lambda x: x["p"]).alias(name))

    out = queries.select(key).join(listed(titles, "by_titles"), key, "left").join(listed(votes, "by_skills"), key, "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(PROFILE)) for c in ("by_titles", "by_skills")})


def axis(profiles: Column) -> Column:
    """``leadership`` if all profiles are of that family, ``ic`` if none is, else null."""
    leads = F.size(F.filter(profiles, lambda p: p["family"] == V.LEADERSHIP))
    return F.when(F.size(profiles) == 0, F.lit(None).cast("string")).when(leads == F.size(profiles), "leadership").when(leads == 0, "ic")


def keys_of(profiles: Column) -> Column:
    return F.flatten(F.transform(profiles, lambda p: F.transform(p["skills"], skill_key)))


def overlap(skills: Column, expected: Column) -> Column:
    """The skills whose key is expected, each key once."""
    keys = F.transform(skills, skill_key)
    return F.filter(skills, lambda s, i: F.array_contains(expected, skill_key(s)) & (F.array_position(keys, skill_key(s)) == i + 1))


def title_verdict(title: Column, noise: Column, profiles: Column) -> Column:
    """noise (no word that a search can use), strong (a profile's title is in it), weak; null if nothing is known of the search."""
    words = X.title_tokens(title)
    usable = F.exists(words, lambda w: X.admitting_term(w) & ~F.array_contains(noise, w))
    strong = F.exists(profiles, lambda p: F.exists(p["titles"], lambda t: says(t, title)))
    return F.when(~usable, "noise").when(F.size(profiles) > 0, F.when(strong, "strong").otherwise("weak"))


def skill_verdict(skill: Column, canonical: Column, profiles: Column) -> Column:
    """noise, strong (a profile expects it), weak (it is in the dictionary, and none does); null otherwise."""
    strong = F.exists(profiles, lambda p: F.exists(p["skills"], lambda s: skill_covers(s, skill)))
    known = F.exists(canonical, lambda c: skill_key(c) == skill_key(skill))
    return F.when(~X.significant_skill(F.lower(skill)), "noise").when(F.size(profiles) > 0, F.when(strong, "strong").when(known, "weak"))


def assessed(queries: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """(key, verdicts, missing, direction, named, off_axis, advised) of each search (titles, skills, noise, canonical: arrays, null for none).

    ``direction`` is set where the titles are all of one side (leadership or not), the skills all of the other, no skill is expected by the titles' profiles
    and four at least by the skills'. ``missing`` are terms that the first profile has and the search doesn't say in any words.
    Searches of the same words are judged once, whatever their number.
    """
    said = ["titles", "skills", "noise", "canonical"]
    q = queries.select(key, *[F.filter(F.coalesce(c, F.array().cast(NONE)), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "").alias(c) for c in said])
    same = F.sha2(F.to_json(F.struct(*said)), 256)
    every = q.select(key, same.alias("__same"))
    q = q.select(same.alias("__same"), *said).groupBy("__same").agg(*[F.first(c).alias(c) for c in said])
    judged = _assessed(q, profiles, "__same")
    return every.join(judged, "__same").select(key, *[c for c in judged.columns if c != "__same"])


def _assessed(q: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    rows = q.join(resolved(q, profiles, key), key)
    rows = rows.withColumn("all", F.concat("by_titles", F.filter("by_skills", lambda p: ~F.exists("by_titles", lambda t: t["profile"] == p["profile"]))))
    verdict = lambda terms, kind, of: F.filter(F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind"), of(t).alias("quality"))), lambda v: v["quality"].isNotNull())
    verdicts = F.concat(verdict(F.col("titles"), "title", lambda t: title_verdict(t, F.col("noise"), F.col("all"))), verdict(F.col("skills"), "skill", lambda s: skill_verdict(s, F.col("canonical"), F.col("all"))))
    first = F.get("all", 0)
    usable = lambda t: F.exists(X.title_tokens(t), lambda w: X.admitting_term(w) & ~F.array_contains("noise", w))
    titles = F.filter(first["titles"], lambda t: usable(t) & ~F.exists("titles", lambda x: says(t, x) | says(x, t)))
    skills = F.filter(first["skills"], lambda s: X.significant_skill(F.lower(s)) & ~F.exists("skills", lambda x: skill_covers(s, x, True)))
    term = lambda terms, kind, most: F.transform(F.slice(F.coalesce(terms, F.array().cast(NONE)), 1, most), lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind")))
    missing = F.concat(term(titles, "title", V.MISSING_TITLES), term(skills, "skill", V.MISSING_SKILLS))
    a, b = axis(F.col("by_titles")), axis(F.col("by_skills"))
    off = overlap(F.col("skills"), keys_of(F.col("by_skills")))
    named = F.slice(F.filter("titles", lambda t: F.exists("by_titles", lambda p: F.exists(p["titles"], lambda e: says(e, t)))), 1, V.NAMED_TITLES)
    against = (a != b) & (F.size(overlap(F.col("skills"), keys_of(F.col("by_titles")))) == 0) & (F.size(off) >= V.OFF_AXIS_SKILLS) & (F.size(named) > 0)
    direction = F.when(F.coalesce(against, F.lit(False)), F.when(a == "leadership", "leadership-titles-ic-skills").otherwise("ic-titles-leadership-skills"))
    advised = F.slice(F.filter(F.get("by_titles", 0)["skills"], lambda s: X.significant_skill(F.lower(s))), 1, V.MISSING_SKILLS)
    out = rows.select(key, verdicts.alias("verdicts"), missing.alias("missing"), direction.alias("direction"), named.alias("named"), off.alias("off_axis"), advised.alias("advised"))
    told = F.col("direction").isNotNull()
    return out.withColumns({c: F.when(told, F.col(c)).otherwise(F.array().cast(NONE)) for c in ("named", "off_axis", "advised")})
