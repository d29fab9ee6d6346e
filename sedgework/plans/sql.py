"""Pieces of the queries' SQL."""

from __future__ import annotations

from sedgework.functions import values as V

START, END = "(^|[^0-9a-z_])", "($|[^0-9a-z_])"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) else q(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


def dealt(table: str, key: str, rows: list[tuple], names: str, more: str = "") -> str:
    """Rows (id and values) dealt out to the rows of a whole table by its key; ``more``: further columns."""
    lit = lambda x: "NULL" if x is None else q(x)
    columns = [f"([{', '.join(lit(r[k]) for r in rows)}])[CAST({key} % {len(rows)} AS BIGINT) + 1] AS {n.strip()}" for k, n in enumerate(names.split(",")) if k]
    return f"(SELECT {key} AS id, {', '.join(columns)}{more} FROM {table})"


def swap(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def lines(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"SELECT {key}, unnest(generate_series(0, len(p) - 1)) AS ord, unnest(p) AS line FROM (SELECT {key}, string_split({text}, chr(10)) AS p FROM {table} WHERE {text} IS NOT NULL)"


def bullet(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, {q(V.BULLET_MARKER)}, ''), {q(V.NUMBERED_BULLET)}, ''))"


def bullets(table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, ord, bullet FROM (SELECT {key}, ord, {bullet('line')} AS bullet FROM ({lines(table, key)})) WHERE length(bullet) > 5"


def words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]')))"


def metric(x: str) -> str:
    strong = " OR ".join(has(x, p) for p in V.STRONG_METRICS)
    year = q(V.YEAR)
    bare = f"regexp_replace(regexp_replace({x}, {year}, '\\1\\3', 'g'), {year}, '\\1\\3', 'g')"
    gap = V.CARDINAL_GAP
    no_year = swap(f"lower({bare})", f"{START}(two{gap}+thousand|nineteen{gap}+hundred)({gap}+and)?{gap}+({V.YEAR_TAIL}){END}", " ")
    return f"({strong} OR {has(bare, '[0-9]')} OR {has(swap(no_year, V.NOT_COUNTING, ' '), f'{START}({V.CARDINALS}){gap}[0-9a-z_]')})"


def verb(x: str) -> str:
    return f"{swap(f'lower(string_split_regex({x}, chr(92) || chr(115))[1])', '[^a-z]')} IN ({', '.join(map(q, V.ACTION_VERBS))})"


def features(table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, ord, {metric('bullet')} AS has_metric, {verb('bullet')} AS verb_led, CAST({words('bullet')} AS INTEGER) AS words FROM ({bullets(table, key)})"


def half(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def key(x: str) -> str:
    return f"trim({swap(f'lower(regexp_replace({x}, {q(V.BULLET_MARKER)}, {q(str())}))', chr(92) + 's+', ' ')})"


def flat(x: str) -> str:
    return f"trim({swap(f'lower(coalesce({x}, {q(str())}))', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+', ' ')})"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


def title_tokens(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex(lower({x}), '[^a-z0-9+#.]+'), lambda t: regexp_replace(t, '^[.]+|[.]+$', '', 'g')), lambda t: t <> '')"


def seniority(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(f'lower({x})', START + '(' + p + ')' + END)} THEN {q(label)}" for label, p in V.SENIORITY_PATTERNS) + " END"


def rung(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {q(k)} THEN {v}" for k, v in V.SENIORITY_RUNGS.items()) + " END"


def tier(x: str) -> str:
    return f"CASE WHEN {x} >= 80 THEN 'high' WHEN {x} >= 60 THEN 'medium' ELSE 'low' END"


def pool(keys: str, rows: str) -> str:
    return f"""SELECT *, {tier('overall')} AS tier FROM (SELECT *, {half('points / 70 * 100')} AS overall FROM (
      SELECT *, CAST(CASE WHEN total >= 3 THEN {half('specificity / 100 * 40')} + {half('structure / 100 * 30')} ELSE 0 END AS BIGINT) AS points FROM (
      SELECT {keys}, count(*) AS total, CAST(sum(CAST(has_metric AS INT)) AS BIGINT) AS metric, CAST(sum(CAST(verb_led AS INT)) AS BIGINT) AS verb_led,
        CAST(sum(CAST(words BETWEEN 8 AND 30 AS INT)) AS BIGINT) AS in_window,
        least(100, {half('CAST(sum(CAST(has_metric AS INT)) AS DOUBLE) / count(*) / 0.6 * 100')}) AS specificity,
        {half('(CAST(sum(CAST(verb_led AS INT)) AS DOUBLE) * 0.5 + CAST(sum(CAST(words BETWEEN 8 AND 30 AS INT)) AS DOUBLE) * 0.5) / count(*) * 100')} AS structure
      FROM ({rows}) GROUP BY {keys})))"""


def html_text(x: str) -> str:
    out = swap(x, "(?is)<(style|script)([^0-9a-z_][^>]*)?>.*?</(style|script)>")
    out = swap(swap(out, "(?i)</(p|li|div|tr)>", "\n"), "(?i)<br\\s*/?>", "\n")
    out = swap(out, "<[^>]+>")
    for name, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = f"replace({out}, {q(name)}, {q(plain)})"
    out = swap(swap(out, "[ \\t\\r\\f]+\n", "\n"), "\n{3,}", "\n\n")
    return swap(out, "^\\s+|\\s+$")


def host(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(regexp_extract({x}, '^[A-Za-z]+://([^/?#:]*)', 1)), '[.]$', ''), '^www[.]', '')"


def canonical(x: str) -> str:
    segments = f"list_filter(string_split(regexp_extract({x}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')"
    segments = f"CASE WHEN coalesce(regexp_matches({segments}[1], '^[A-Za-z]{{2}}-[A-Za-z]{{2}}$'), false) THEN {segments}[2:] ELSE {segments} END"
    name = "lower(string_split(p, '=')[1])"
    kept = f"list_sort(list_filter(string_split(regexp_extract({x}, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' AND {name} NOT IN ({', '.join(map(q, V.TRACKING_PARAMS))}) AND NOT starts_with({name}, 'utm_')))"
    return f"""CASE WHEN regexp_matches(lower({x}), '^https?://') THEN lower(regexp_extract({x}, '^([A-Za-z]+)://', 1)) || '://' || {host(x)} || regexp_extract({x}, '^[A-Za-z]+://[^/?#:]*(:[0-9]+)', 1)
      || '/' || array_to_string({segments}, '/') || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"""
