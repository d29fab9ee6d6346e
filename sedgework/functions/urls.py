"""URL functions: canonical form, slug, host classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgework.functions import values as V

URL = "^(?i)(https?)://([^/?#]*)([^?#]*)([?]([^#]*))?"
PLATFORMS = (
    ("greenhouse", "^https?://(job-)?boards[.]greenhouse[.]io/[^/?#]+/jobs/[0-9]+"),
    ("lever", "^https?://jobs[.](eu[.])?lever[.]co/[^/?#]+/[^/?#]+"),
    ("workable", "^https?://apply[.]workable[.]com/[^/?#]+/j/[^/?#]+"),
    ("recruitee", "^https?://[^./?#]+[.]recruitee[.]com/o/[^/?#]+"),
    ("ashby", "^https?://jobs[.]ashbyhq[.]com/[^/?#]+/[^/?#]+"),
)


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike("^https?://"), F.lit(False))


def host(url: Column) -> Column:
    """Lower case host without ``www.`` and a closing dot."""
    found = F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#:]*)", 1))
    return F.regexp_replace(F.regexp_replace(found, "[.]$", ""), "^www[.]", "")


def canonical(url: Column) -> Column:
    """One form for all addresses of a page; null unless http(s).

    Host in lower case without ``www.``; no locale as first segment, fragment, empty segments or
    tracking parameters; the other parameters sorted.
    """
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))
    port = F.regexp_extract(url, "^[A-Za-z]+://[^/?#:]*(:[0-9]+)", 1)
    path = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    local = F.coalesce(F.get(segments, F.lit(0)).rlike("^[A-Za-z]{2}-[A-Za-z]{2}$"), F.lit(False))
    segments = F.when(local, F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1)))).otherwise(segments)
    query = F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).isin(*V.TRACKING_PARAMS) & ~name(p).startswith(V.TRACKING_PREFIX))
    kept = F.array_sort(kept)
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(is_http(url), F.concat(scheme, F.lit("://"), host(url), port, F.lit("/"), F.array_join(segments, "/"), rest))


def slug(url: Column) -> Column:
    """Host and path in lower case, without ``www.`` and a closing slash."""
    bare = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^?#]*)", 1)), "/+$", "")
    return F.regexp_replace(bare, "^www[.]", "")


def platform(url: Column) -> Column:
    """The posting platform that a URL belongs to; null for others."""
    return F.coalesce(*[F.when(F.lower(url).rlike(p), F.lit(n)) for n, p in PLATFORMS])
