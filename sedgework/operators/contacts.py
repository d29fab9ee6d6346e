"""Contact data from the first lines of documents: the first of each kind, and the lines that they take up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.functions import dates as T
from sedgework.functions import shapes as H
from sedgework.functions import values as V
from sedgework.operators.credentials import URL

GITHUB = "(?i)(?:https?://)?(?:www[.])?github[.]com/[A-Za-z0-9_-]+/?"


def parts(text: Column) -> Column:
    """The cells of a contact line: between bars, dots and wide gaps."""
    return F.filter(F.transform(F.split(text, "\\s*[|·•∙]\\s*|\\s{3,}"), F.trim), lambda p: p != "")


def links(text: Column) -> Column:
    """The links of a line that stand alone and are neither of an e-mail address nor of a network's profile."""
    bare = F.regexp_replace(text, V.EMAIL, " ")
    hits = F.regexp_extract_all(bare, F.lit(f"({URL})"), 1)
    return F.filter(hits, lambda u: H.is_standalone_url(u, bare) & H.is_website(u) & ~u.rlike("(?i)linkedin[.]com|github[.]com"))


def contacts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, email, phone, linkedin, github, links, location, consumed) of documents by their lines (ord, text) above the first section.

    Of each kind the first, links all in order; ``location`` is the first cell that is a place alone. ``consumed`` are the lines that gave something. Null texts give nothing.
    """
    text = F.coalesce("text", F.lit(""))
    phone = T.first_of(F.regexp_replace(text, URL, " "), f"(?<![0-9]){V.PHONE}(?![0-9])")
    found = {"email": T.first_of(text, V.EMAIL), "phone": phone, "linkedin": T.first_of(text, V.LINKEDIN_PROFILE), "github": T.first_of(text, GITHUB), "location": F.get(F.filter(parts(text), H.is_bare_place), 0)}
    rows = lines.select(*keys, "ord", *[c.alias(n) for n, c in found.items()], links(text).alias("links"))
    gave = F.size("links") > 0
    for n in found:
        gave = gave | F.col(n).isNotNull()
    first = [F.min(F.when(F.col(n).isNotNull(), F.struct("ord", n)))[n].alias(n) for n in found]
    ordered = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "links"))), lambda x: x["links"]))
    out = rows.groupBy(*keys).agg(*first, F.array_distinct(ordered).alias("links"), F.sort_array(F.collect_list(F.when(gave, F.col("ord")))).alias("consumed"))
    return out.select(*keys, "email", "phone", "linkedin", "github", "links", "location", "consumed")
