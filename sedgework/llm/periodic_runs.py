"""Maximal periodic runs of words, found by the algorithm of Kolpakov and Kucherov.

A text's words are factorised by Lempel and Ziv (each factor is the longest stretch that also starts
earlier, found in a suffix automaton with the first end of each state). A run that meets a factor's border is
found there by Main's algorithm (longest common prefixes and suffixes with the text around the border); a
run strictly inside of a factor is a copy of one at the factor's earlier occurrence.

Only stretches that may hold a wanted run go through this: in a run of at least ``length`` words and
``exponent`` periods every window of some words (``Settings.window``) occurs a second time, one period
away, so a run never leaves a stretch of windows that occur twice in their text. The windows are compared by
hashes; equal hashes of different windows make a stretch longer and change no result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgework.llm.common import mix64, slices, table, tidied


@dataclass(frozen=True)
class Settings:
    """A run has at least ``length`` words and ``exponent`` times its period."""

    length: int = 24
    exponent: int = 3

    @property
    def window(self) -> int:
        """Each window of so many words of a run of n words and period q recurs in it: it is at most n - 2 q + 1, which is at least this."""
        return self.length * (self.exponent - 2) // self.exponent + 1


def automaton(w: list[int]) -> tuple[list[dict], list[int]]:
    """The suffix automaton of ``w``: transitions of each state, and where its strings end first."""
    steps, link, size, first, last = [{}], [-1], [0], [-1], 0
    for i, c in enumerate(w):
        new, p = len(steps), last
        steps.append({})
        link.append(0)
        size.append(i + 1)
        first.append(i)
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            old = steps[p][c]
            if size[old] == size[p] + 1:
                link[new] = old
            else:
                twin = len(steps)
                steps.append(steps[old].copy())
                link.append(link[old])
                size.append(size[p] + 1)
                first.append(first[old])
                while p >= 0 and steps[p].get(c) == old:
                    steps[p][c] = twin
                    p = link[p]
                link[old] = link[new] = twin
        last = new
    return steps, first


def factors(w: list[int]) -> Iterator[tuple[int, int, int]]:
    """Start, length and an earlier start (-1: none) of each Lempel-Ziv factor; a factor may overlap its earlier occurrence."""
    steps, first = automaton(w)
    at, n = 0, len(w)
    while at < n:
        state, end = 0, at
        while end < n and first[nxt := steps[state][w[end]]] < end:
            state, end = nxt, end + 1
        yield (at, 1, -1) if end == at else (at, end - at, first[state] - (end - at) + 1)
        at = max(end, at + 1)


def prefixes(s: list[int]) -> list[int]:
    """For each place of ``s`` the length of the longest common prefix of ``s`` and what starts there."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[i + k] == s[k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def border_runs(w: list[int], low: int, b: int, high: int, periods: int, want: Settings) -> Iterator[tuple[int, int, int]]:
    """Main's algorithm: runs (start, end, period) in ``w[low:high]`` that cross or touch ``b``, maximal in ``w``."""
    left, right = b - low, high - b
    ahead = prefixes([*w[b:high], -1, *w[low:high]])
    back = prefixes([*w[low:b][::-1], -1, *w[low:high][::-1]])
    for q in range(1, periods + 1):
        found = []
        if q <= right:  # a whole period lies behind the border
            found.append((b - back[left + 1 + right - q], b + q + (ahead[q] if q < right else 0)))
        if q <= left:  # a whole period lies before it
            found.append((b - q - (back[q] if q < left else 0), b + ahead[right + 1 + left - q]))
        for start, end in found:
            if end - start >= max(want.length, want.exponent * q) and not (start == low > 0 and w[start - 1] == w[start - 1 + q]) and (end < high or end == len(w) or w[end] != w[end - q]):
                yield start, end, q


def maximal_runs(w: list[int], want: Settings) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of ``w`` that are long enough, by start and period."""
    found: dict[int, dict[int, int]] = defaultdict(dict)

    def add(start: int, end: int, q: int) -> None:
        found[start][end] = min(q, found[start].get(end, q))

    before = 0
    for b, size, source in [*factors(w), (len(w), 0, -1)]:
        periods = (before + size) // (want.exponent - 1)
        if before + size + periods >= want.length:
            for run in border_runs(w, max(0, b - before - periods - 1), b, b + size, periods, want):
                add(*run)
        shift = b - source
        if source >= 0:
            for start in range(source + 1, source + size - want.length):
                for end, q in list(found.get(start, {}).items()):
                    if end < source + size:
                        add(start + shift, end + shift, q)
        before = size
    return sorted((s, e - s, q) for s, ends in found.items() for e, q in ends.items())


def repeated(ids: np.ndarray, part: np.ndarray, width: int) -> np.ndarray:
    """Whether the window of ``width`` words that starts here lies in one part and occurs in it twice."""
    n = len(ids)
    out = np.zeros(n, bool)
    if n < width:
        return out
    h = np.zeros(n - width + 1, np.uint64)
    words = mix64(ids.astype(np.uint64) + np.uint64(1))
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k]
    whole = part[: n - width + 1] == part[width - 1 :]
    at = np.flatnonzero(whole)
    h = mix64(h[at] ^ mix64(part[at].astype(np.uint64)))
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out[at[order[1:][same]]] = out[at[order[:-1][same]]] = True
    return out


def stretches(ids: np.ndarray, part: np.ndarray, want: Settings) -> list[tuple[int, int]]:
    """Stretches of words that may hold a run: each of their windows occurs twice in the stretch's part."""
    width = want.window
    at = np.arange(len(ids))
    for _ in range(2):  # first within texts, then within what that leaves of them
        flags = repeated(ids[at], part, width)
        new = part[1:] != part[:-1]
        begins, ends = flags.copy(), flags.copy()
        begins[1:] &= ~flags[:-1] | new
        ends[:-1] &= ~flags[1:] | new
        found = [(int(at[a]), int(at[b]) + width) for a, b in zip(np.flatnonzero(begins), np.flatnonzero(ends), strict=True) if b - a + width >= want.length]
        if not found:
            break
        at = np.concatenate([np.arange(a, b) for a, b in found])
        part = np.repeat(np.arange(len(found)), [b - a for a, b in found])
    return found


def runs_of(texts: list[list[bytes]], want: Settings) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    known: dict = defaultdict(count().__next__)
    ids = np.fromiter(map(known.__getitem__, (x for t in texts for x in t)), np.int64, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    for a, b in stretches(ids, np.repeat(np.arange(len(texts)), lengths), want):
        of = int(np.searchsorted(starts, a, "right")) - 1
        out[of] += [(a - int(starts[of]) + s, n, q) for s, n, q in maximal_runs(ids[a:b].tolist(), want)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def collapse_runs(docs: DataFrame, column: str = "text", want: Settings | None = None) -> DataFrame:
    """Add ``words`` (their number), ``runs`` (by start, then period) and ``collapsed`` (the text without repeats).

    Words are stretches without the six ASCII white-space characters. A null or empty text has no word,
    no run and an empty ``collapsed``. Rows are judged by their own text alone: repeated rows, null ids and further
    columns pass as they are, columns of the new names are replaced, and an empty table stays empty. Memory is
    that of the longest text's repeated stretches. No shuffle.
    """
    want = want or Settings()
    new = {"words": "bigint", "runs": f"array<{RUN}>", "collapsed": "string"}
    docs = docs.drop(*new)
    schema = docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in new.items()]).schema
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in tidied(batches):
            texts = whole.column(whole.schema.get_field_index(column)).cast(pa.binary())
            for part in slices(np.fromiter((len(t.as_buffer()) if t.is_valid else 0 for t in texts), np.int64, len(texts)), 4_000_000):
                words = [t.split() if t else [] for t in texts[part].to_pylist()]
                found = runs_of(words, want)
                values = [
                    pa.array(list(map(len, words)), pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found], kind),
                    pa.array([collapsed(w, runs).decode() for w, runs in zip(words, found, strict=True)], pa.string()),
                ]
                b = whole.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*b.columns, *values], names=[*b.schema.names, *new])

    return docs.mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in a tenth of the documents all words from one on repeat the words behind it.

    With h the crc32 of the id's decimal text and g = h div 10, the texts of h % 10 = 0 are made periodic from word
    a = g % n on, with period 1 + (n - a) div (3 + g % 8). A text without words and a null id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.nullif(F.size(words), F.lit(0))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    repeats = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    periodic = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), repeats), F.lit(1), n), " ")
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(periodic, F.col("text"))).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of all documents, in digests, and the run of the greatest exact exponent (ties: smallest start, then period)."""
    found = collapse_runs(with_planted_runs(table(spark, sf_dir, "documents"))).drop("text")
    none = F.lit(None).cast(RUN)
    # runs come by start and period, so a later one wins by a greater exponent alone
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
