"""Removal of repeated passages by a distributed, sparse suffix array.

A suffix is kept for the array only where it starts at an anchor: the place of the smallest hashed
gram inside some window of ``min_bytes`` bytes. The anchor is a function of the window's bytes alone,
so equal windows have the same anchor, and all equal windows meet where their anchors' suffixes meet.

1. Sampled splitters range-partition the anchored suffixes by their leading tokens (words of 8 bytes,
   the second cut at the gram's end). A splitter never divides suffixes that begin with the same
   gram, so no comparison is left across a boundary.
   A gram of which the sample foretells more than ``hot_pieces`` pieces has no bucket of its own: its
   pieces are taken apart into windows, dealt by the windows' hashes. Of equal windows (and pieces)
   of a batch of documents only those of the smallest document travel; for the others it is known
   already that they are covered. So a bucket gets one row a batch of a window that all have.
2. Each bucket sorts its suffixes by multikey quicksort, one token after another, among ties only.
   Suffixes of a gram that one document has alone leave. For the others the text around the anchor
   (the windows that it stands for) is compared: equal pieces at once, unequal ones window by window.
3. The byte ranges found are grouped by document and cut out of the text.

Each row sent to a bucket is a compressed block of all pieces that a batch of documents has for it;
equal pieces within a batch are sent once, with the smallest document.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgework.llm.common import forget, mix64, slices, table, tidied, tidy

GRAM = 12
TOP = np.uint64(0xFFFFFFFF00000000)


@dataclass(frozen=True)
class Settings:
    """``bucket_bytes``: text for each bucket of suffixes; ``sample``: documents (at most, about) that splitters are drawn from; ``chunk``: pieces whose windows are compared at a time; ``hot_pieces``: beyond these a gram is split."""

    min_bytes: int = 50
    bucket_bytes: int = 4_000_000
    group_bytes: int = 4_000_000
    batch_bytes: int = 8_000_000
    sample: int = 2_000
    chunk: int = 60_000
    hot_pieces: int = 100_000


def token(buf: np.ndarray, at: int) -> np.ndarray:
    """The 8 bytes from each place + ``at`` on as big-endian words (``buf`` has slack at its end)."""
    n = len(buf) - 16 - at
    return np.ndarray((n,), ">u8", buf, at, (1,)).astype(np.uint64)


def anchors(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``width`` bytes with one anchor: document row, first window, last window, anchor."""
    n = len(buf) - 32
    h = mix64(token(buf, 0)[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix64(token(buf, 4)[:n] & np.uint64(0xFFFFFFFF)))
    at = np.arange(n, dtype=np.int32)
    span, places = 1, width - GRAM + 1
    while span < places:  # leftmost minimum of a doubling window
        step = min(span, places - span)
        left, right = h[: len(h) - step], h[step:]
        take = right < left
        h, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        span += step
    counts = np.maximum(0, sizes - width + 1)
    doc = np.repeat(np.arange(len(sizes)), counts)
    window = np.arange(len(doc)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    a = at[window]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])))) if len(a) else np.zeros(0, np.int64)
    last = np.concatenate((new[1:], [len(a)])).astype(np.int64) - 1 if len(a) else new
    return doc[new], window[new], window[last], a[new].astype(np.int64)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array with slack around each, the start and size of each."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = b"\0" * 64
    buf = np.frombuffer(pad + pad.join(texts) + pad * 2, np.uint8)
    return buf, np.cumsum(sizes + 64) - sizes, sizes


def pieces(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Document row, anchor's place in it, first and last window before the anchor, and the bytes around it."""
    buf, starts, sizes = joined(texts)
    doc, first, last, a = anchors(buf, starts, sizes, width)
    reach = width - GRAM  # bytes before the anchor
    rows = np.lib.stride_tricks.sliding_window_view(buf, reach + width)[a - reach]
    far, near = (a - first).astype(np.uint8), (a - last).astype(np.uint8)
    rows = rows * covered(far, near, width)
    return doc, (a - starts[doc]).astype(np.uint32), far, near, rows


def leading(rows: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram at the anchor as two tokens."""
    two = np.ascontiguousarray(rows[:, reach : reach + 16]).view(">u8").astype(np.uint64)
    return two[:, 0], two[:, 1] & TOP


def place(first: np.ndarray, second: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The bucket of each pair of tokens among sorted splitters (k x 2)."""
    out = np.searchsorted(cuts[:, 0], first, "right")
    at = np.searchsorted(cuts[:, 0], first, "left")
    tied = np.flatnonzero(at < out)  # the first token is that of a splitter: the second decides
    if len(tied):
        all_cuts = [tuple(c) for c in cuts.tolist()]
        out[tied] = [bisect.bisect_right(all_cuts, key) for key in zip(first[tied].tolist(), second[tied].tolist(), strict=True)]
    return out


def row_hash(rows: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view("<u8")
    odd = np.array([pow(0x9E3779B97F4A7C15, k + 3, 1 << 64) for k in range(words.shape[1])], np.uint64)
    out = far.astype(np.uint64) << np.uint64(8) | near
    for k in range(words.shape[1]):
        out = mix64(out + words[:, k]) * odd[k]
    return mix64(out)


def multikey(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sort by several tokens, later ones among ties only: the order, and the group of each sorted row (equal in all tokens)."""
    order = np.argsort(tokens[0], kind="stable")
    group = np.concatenate(([0], np.cumsum(tokens[0][order][1:] != tokens[0][order][:-1]))) if len(order) else order
    for t in tokens[1:]:
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        sub = order[tied]
        inner = np.lexsort((t[sub], group[tied]))
        order[tied] = sub = sub[inner]
        key = t[sub]
        new = np.zeros(len(order), bool)
        new[tied[1:]] = (key[1:] != key[:-1]) & (tied[1:] - tied[:-1] == 1)
        start = np.concatenate(([False], group[1:] != group[:-1]))
        group = np.cumsum(start | new)
    return order, group


def covered(far: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """Which of the bytes around each anchor its windows cover."""
    col, reach = np.arange(2 * width - GRAM), width - GRAM
    return (col >= (reach - far.astype(np.int16))[:, None]) & (col < (reach - near.astype(np.int16) + width)[:, None])


def steps(sorted_: np.ndarray) -> np.ndarray:
    """Differences of sorted small numbers, which compress better."""
    return np.diff(sorted_, prepend=0).astype(np.uint32)


def planes(x: np.ndarray) -> np.ndarray:
    """32-bit numbers byte by byte: all first bytes, then all second ones and so on."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def joined_planes(planes_: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes_.reshape(4, -1).T).view("<u4").ravel()


def pack(arrays: list[np.ndarray]) -> bytes:
    head = struct.pack(f"<{len(arrays)}q", *(a.nbytes for a in arrays))
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 6)


def unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}q", raw), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


#: Of a block of pieces: document ids and text hashes; row of the document (differences), anchor (planes), far and near of pieces and of their copies in other documents; the pieces' bytes.
BLOCK = [np.int64, np.int64, np.uint32, np.uint8, np.uint8, np.uint8, np.uint32, np.uint8, np.uint8, np.uint8, np.uint8]


def runs_of(values: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of equal neighbours of a sorted array of numbers >= 0."""
    ends = (np.flatnonzero(np.diff(values, append=-1)) + 1).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []


def is_hot(first: np.ndarray, second: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which pairs of tokens are among some (k x 2)."""
    out = np.zeros(len(first), bool)
    if len(hot):
        some = np.flatnonzero(np.isin(first, hot[:, 0]))
        known = set(map(tuple, hot.tolist()))
        out[some] = [key in known for key in zip(first[some].tolist(), second[some].tolist(), strict=True)]
    return out


def apart(rows: np.ndarray, far: np.ndarray, near: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The windows of some pieces: piece, place of the anchor in the window, and two hashes of its bytes."""
    parts = []
    for lo in range(0, len(rows), 10_000):
        f, n = far[lo : lo + 10_000].astype(np.int64), near[lo : lo + 10_000].astype(np.int64)
        of = np.repeat(np.arange(len(f)), f - n + 1)
        d = (np.arange(len(of)) - np.repeat(np.cumsum(f - n + 1) - (f - n + 1), f - n + 1) + n[of]).astype(np.uint8)
        bytes_ = rows[lo : lo + 10_000][of] * covered(d, d, width)
        parts.append((of + lo, d, row_hash(bytes_, d, d), row_hash(bytes_[:, ::-1], d, d)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def stand_ins(gram: np.ndarray, d: np.ndarray, one: np.ndarray, two: np.ndarray, width: int) -> np.ndarray:
    """In place of each window's bytes: its gram, its two hashes beside that, zeros."""
    out = np.zeros((len(d), width), np.uint8)
    row, at = np.arange(len(d))[:, None], d.astype(np.int64)
    out[row, at[:, None] + np.arange(GRAM)] = gram
    beside = np.where(at + GRAM + 16 <= width, at + GRAM, at - 16)
    out[row, beside[:, None] + np.arange(16)] = np.stack([one, two], 1).view(np.uint8)
    return out


def blocks_of(ids: np.ndarray, hashes: np.ndarray, texts: list[bytes], cuts: np.ndarray, width: int, hot: np.ndarray, spread: int) -> Iterator[tuple[int, bytes]]:
    """The blocks (bucket, bytes) of a batch of documents, sorted by id. Windows of hot grams go to ``spread`` buckets beyond those of the splitters."""
    reach = width - GRAM
    parts, around = [], []
    for part in slices([len(t) for t in texts], 750_000):
        doc, a, far, near, rows = pieces(texts[part], width)
        two = leading(rows, reach)
        parts.append((doc + part.start, a, far, near, np.where(is_hot(*two, hot), -1, place(*two, cuts)), row_hash(rows, far, near)))
        around.append(rows)
    if not parts:
        return
    doc, a, far, near, bucket, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    rows, at = np.empty((len(doc), reach + width), np.uint8), len(doc)
    while around:  # each part is freed as it is copied
        part = around.pop()
        rows[at - len(part) : at] = part
        at -= len(part)
    order = np.lexsort((doc, key, bucket))
    same = np.zeros(len(order), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (bucket[order][1:] == bucket[order][:-1])
    for lo, hi in runs_of(bucket[order]):
        here = order[lo:hi]
        head = here[np.maximum.accumulate(np.where(same[lo:hi], 0, np.arange(hi - lo)))]
        later = ids[doc[here]] > ids[doc[head]]  # covered already; what a document repeats itself is no copy
        mine, copy = here[~later], here[later]
        mine, copy = np.sort(mine), np.sort(copy)
        pieces_, copies = (doc[mine], a[mine], far[mine], near[mine]), (doc[copy], a[copy], far[copy], near[copy])
        if bucket[order[lo]] >= 0:
            yield int(bucket[order[lo]]), block(ids, hashes, pieces_, copies, rows[mine][covered(far[mine], near[mine], width)])
        else:
            yield from hot_blocks(ids, hashes, pieces_, copies, rows[mine], len(cuts) + 1, spread, width)


def block(ids: np.ndarray, hashes: np.ndarray, mine: tuple, copies: tuple, text: np.ndarray) -> bytes:
    """Pieces and copies (document row, anchor, far, near; sorted by document) as bytes."""
    used, at = np.unique(np.concatenate((mine[0], copies[0])), return_inverse=True)
    m = len(mine[0])
    return pack([ids[used], hashes[used], steps(at[:m]), planes(mine[1]), mine[2], mine[3], steps(at[m:]), planes(copies[1]), copies[2], copies[3], text])


def hot_blocks(ids: np.ndarray, hashes: np.ndarray, mine: tuple, copies: tuple, rows: np.ndarray, base: int, spread: int, width: int) -> Iterator[tuple[int, bytes]]:
    """The blocks of a batch's pieces of hot grams: their windows by hash, and all that is known to be copied in one block anywhere."""
    of, d, one, two = apart(rows, mine[2], mine[3], width)
    doc, a = mine[0][of], mine[1][of]
    order = np.lexsort((doc, two, one))
    same = np.zeros(len(order), bool)
    same[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    later = ids[doc[order]] > ids[doc[head]]
    # neighbouring windows of a piece are one copy
    c = np.sort(order[later])
    new = np.ones(len(c), bool)
    new[1:] = (of[c][1:] != of[c][:-1]) | (d[c][1:] != d[c][:-1] + np.uint8(1))
    start, end = c[new], c[np.append(np.flatnonzero(new)[1:] - 1, len(c) - 1)] if len(c) else c
    known = [np.concatenate(x) for x in zip(copies, (doc[start], a[start], d[end], d[start]), strict=True)]
    by = np.argsort(known[0], kind="stable")
    none = tuple(x[:0] for x in mine)
    if len(by):
        yield base + int(hashes[0]) % spread, block(ids, hashes, none, tuple(x[by] for x in known), np.zeros(0, np.uint8))
    left = order[~later]
    to = (mix64(one[left]) % np.uint64(spread)).astype(np.int64)
    left = left[np.lexsort((left, to))]
    for lo, hi in runs_of(np.sort(to)):
        w = left[lo:hi]
        gram = rows[of[w], width - GRAM : width]
        yield base + int(mix64(one[w[:1]])[0] % np.uint64(spread)), block(ids, hashes, (doc[w], a[w], d[w], d[w]), none, stand_ins(gram, d[w], one[w], two[w], width).ravel())


def whole_groups(group: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges that cover a sorted array of group numbers, of whole groups and at most ``most`` long (a larger group is one range)."""
    ends = np.flatnonzero(np.diff(group, append=-1)) + 1
    lo = 0
    while lo < len(group):
        k = int(np.searchsorted(ends, lo + most, "right")) - 1
        if k < 0 or ends[k] <= lo:
            k += 1
        yield lo, int(ends[k])
        lo = int(ends[k])


def matches(blobs: list[bytes], width: int, chunk: int = 60_000, single: bool = False) -> tuple[np.ndarray, ...]:
    """Of one bucket: id, text hash, start and end of each byte range that a smaller document has too. ``single``: each piece is one window."""
    reach = width - GRAM
    ids, hashes, doc, a, far, near, cdoc, ca, cfar, cnear, rows = ([] for _ in BLOCK)
    base = 0
    for blob in blobs:
        got = unpack(blob, BLOCK)
        for k in (2, 6):
            got[k], got[k + 1] = np.cumsum(got[k], dtype=np.int64) + base, joined_planes(got[k + 1])
        base += len(got[0])
        for to, x in zip((ids, hashes, doc, a, far, near, cdoc, ca, cfar, cnear, rows), got, strict=True):
            to.append(x)
    ids, hashes, doc, a, far, near, cdoc, ca, cfar, cnear, rows = map(np.concatenate, (ids, hashes, doc, a, far, near, cdoc, ca, cfar, cnear, rows))
    text, rows = rows, np.zeros((len(doc), reach + width), np.uint8)
    rows[covered(far, near, width)] = text
    owner = ids[doc]
    order, group = multikey(list(leading(rows, reach)))
    n = int(group[-1]) + 1 if len(group) else 0
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, group, owner[order])
    np.maximum.at(high, group, owner[order])
    shared = low < high
    keep = shared[group]
    order, group = order[keep], group[keep]
    # equal pieces: all but those of the smallest document are covered
    key = row_hash(rows[order], far[order], near[order])
    by = np.lexsort((owner[order], key, group))
    order, group, key = order[by], group[by], key[by]
    head = np.ones(len(order), bool)
    head[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    whole = owner[order] > owner[order[first]]
    whole_rows = order[whole]
    out = [(np.concatenate((doc[whole_rows], cdoc)).astype(np.int64), np.concatenate((a[whole_rows], ca)).astype(np.int64) - np.concatenate((far[whole_rows], cfar)), np.concatenate((a[whole_rows], ca)).astype(np.int64) - np.concatenate((near[whole_rows], cnear)) + width)]
    # unequal pieces of a gram: window by window
    kinds = np.bincount(group[head], minlength=n) if len(order) else np.zeros(0, int)
    left = np.flatnonzero(~whole & (kinds[group] > 1)) if len(order) and not single else np.zeros(0, int)
    rest, g = order[left], group[left]
    for lo, hi in whole_groups(g, chunk):
        out.append(windows(rest[lo:hi], g[lo:hi], rows, far, near, doc, a, owner, width))
    d, start, end = (np.concatenate(x) for x in zip(*out, strict=True))
    return ids[d], hashes[d], start, end


def windows(rest, g, rows, far, near, doc, a, owner, width) -> tuple[np.ndarray, ...]:
    """Ranges of the windows of some pieces that a piece of the same gram in a smaller document has too."""
    reach = width - GRAM
    cols = np.ascontiguousarray(rows[rest].T)
    powers = [np.uint64(pow(0x5851F42D4C957F2D, k, 1 << 64)) for k in range(len(cols))]
    term = lambda k: (cols[k].astype(np.uint64) + np.uint64(1)) * powers[k]
    rolled = np.zeros(len(rest), np.uint64)
    for k in range(reach, reach + width):
        rolled += term(k)
    hit = np.zeros((len(rest), reach + 2), bool)
    salt = mix64(g.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    for d in range(reach + 1):
        s = reach - d
        if d:
            rolled += term(s)
            rolled -= term(s + width)
        live = np.flatnonzero((far[rest] >= d) & (near[rest] <= d))
        if len(live) < 2:
            continue
        key = mix64(rolled[live]) ^ salt[live]
        own = owner[rest[live]]
        by = np.lexsort((own, key))
        key, own = key[by], own[by]
        head = np.concatenate(([True], key[1:] != key[:-1]))
        low = own[np.maximum.accumulate(np.where(head, np.arange(len(own)), 0))]
        hit[live[by[own > low]], d] = True
    turn = np.diff(hit.astype(np.int8), axis=1, prepend=np.int8(0))
    r0, d0 = np.nonzero(turn == 1)
    r1, d1 = np.nonzero(turn == -1)  # runs of a row come in the same order
    at = a[rest[r0]].astype(np.int64)
    return doc[rest[r0]].astype(np.int64), at - (d1 - 1), at - d0 + width


def splitters(docs: DataFrame, rows: int, count: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """``count`` - 1 splitters (leading tokens) at most and the hot grams, from the anchored suffixes of a bounded sample of documents."""
    width, reach = settings.min_bytes, settings.min_bytes - GRAM
    share = min(1.0, settings.sample / max(1, rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in slices([len(t) for t in b["raw"]], 1_500_000):
                two = leading(pieces([bytes(t) for t in b["raw"].iloc[part]], width)[4], reach)
                # one in eight, spread over the sorted suffixes
                order = np.lexsort(two[::-1])[4::8]
                yield pd.DataFrame({"a": two[0][order].astype(np.int64), "b": two[1][order].astype(np.int64)})

    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("splitters")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("raw")
    got = drawn.mapInPandas(run, "a long, b long").toPandas()
    a, b = got["a"].to_numpy(np.int64).astype(np.uint64), got["b"].to_numpy(np.int64).astype(np.uint64)
    order = np.lexsort((b, a))
    none = np.zeros((0, 2), np.uint64)
    if not len(order) or count < 2:
        return none, none
    drawn = np.stack([a[order], b[order]], 1)
    hot = none
    if width >= GRAM + 31:  # two hashes fit beside the gram
        grams, of, times = np.unique(drawn, axis=0, return_inverse=True, return_counts=True)
        often = (times > 1) & (times * 8 / share >= settings.hot_pieces)
        hot, drawn = grams[often], drawn[~often[of.ravel()]]
    cuts = drawn[(np.arange(1, count) * len(drawn)) // count] if len(drawn) else none
    return np.unique(cuts, axis=0), hot


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left."""
    kept, end, runs = [], -1, 0
    last = 0
    for s, e in sorted(spans):
        if s > end:
            runs += 1
            kept.append(raw[last:s])
        end = last = max(end, e)
    left = b"".join([*kept, raw[last:]])
    return len(raw) - len(left), runs, left


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each byte of a text that a string of ``min_bytes`` bytes covers which a row of smaller doc_id has too.

    ``docs`` has doc_id and text; one row out for each row in: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and, with ``with_text``, ``kept`` (string; bytes of a character that was cut apart are
    left out), then the columns to ``carry``, as they are. An empty table gives no rows. Null texts count as empty. Rows of a null doc_id keep their whole text and take nothing
    from others. Rows of equal doc_id take nothing from each other.
    """
    width = settings.min_bytes
    carried = [F.col(c).alias(f"__{c}") for c in carry]
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"), *carried)
    base = base.withColumn("hash", F.xxhash64("doc_id", "raw"))
    size = base.agg(F.count("*").alias("rows"), F.sum(F.octet_length("raw")).alias("bytes")).first()
    buckets = max(64, -(-(size["bytes"] or 0) // settings.bucket_bytes))
    groups = max(64, -(-(size["bytes"] or 0) // settings.group_bytes))
    cuts, hot = splitters(base, size["rows"], buckets, settings)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()

        def flush(held: list) -> pa.RecordBatch:
            held.sort(key=lambda r: r[0])
            ids, hashes = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
            out = list(blocks_of(ids, hashes, [r[2] for r in held], cuts, width, hot, buckets))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "block"])

        held, total = [], 0
        for b in tidied(w.slice(at, 1_000) for w in batches for at in range(0, w.num_rows, 1_000)):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                total += len(row[2])
                if total >= settings.batch_bytes:
                    yield flush(held)
                    held, total = [], 0
                    tidy()
        if held:
            yield flush(held)

    def compare(t: pa.Table) -> pa.Table:
        ids, hashes, start, end = matches(t.column("block").to_pylist(), width, settings.chunk, t.column("bucket")[0].as_py() > len(cuts))
        tidy()
        to = (hashes % groups).astype(np.int32)
        order = np.lexsort((start, hashes, ids, to))
        out = []
        for lo, hi in runs_of(to[order]):
            o = order[lo:hi]
            out.append((int(to[o[0]]), pack([ids[o], hashes[o], start[o].astype(np.uint32), (end - start)[o].astype(np.uint32)])))
        return pa.table({"grp": pa.array([x[0] for x in out], pa.int32()), "spans": pa.array([x[1] for x in out], pa.binary())})

    long_enough = base.where((F.octet_length("raw") >= width) & F.col("doc_id").isNotNull())
    found = long_enough.select("doc_id", "hash", "raw").mapInArrow(send, "bucket int, block binary").groupBy("bucket").applyInArrow(compare, "grp int, spans binary")
    grp = F.pmod(F.col("hash"), F.lit(groups)).cast("int")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()

        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            t = t.take(pc.sort_indices(t, [("grp", "ascending")])).combine_chunks()
            to, out = t.column("grp").to_numpy(), []
            for lo, hi in runs_of(to):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as w:
                    w.write_table(pa.table({n: pc.take(t.column(n), np.arange(lo, hi)) for n in t.schema.names}, schema=t.schema))
                out.append((int(to[lo]), sink.getvalue().to_pybytes()))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["grp", "docs"])

        held, total = [], 0
        for b in tidied(batches):
            held.append(b)
            total += b.nbytes
            if total >= settings.batch_bytes:
                yield flush(held)
                held, total = [], 0
        if total:
            yield flush(held)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        spans: dict[tuple[int, int], list] = {}
        for blob in right.column("spans").to_pylist():
            for i, h, s, n in zip(*(x.tolist() for x in unpack(blob, [np.int64, np.int64, np.uint32, np.uint32])), strict=True):
                spans.setdefault((i, h), []).append((s, s + n))
        parts = [cut_documents(pa.ipc.open_stream(blob).read_all(), spans) for blob in left.column("docs").to_pylist()]
        return pa.concat_tables(parts)

    def cut_documents(left: pa.Table, spans: dict) -> pa.Table:
        rows = []
        for i, h, raw in zip(*(left.column(c).to_pylist() for c in ("doc_id", "hash", "raw")), strict=True):
            removed, runs, kept = cut(raw, spans.get((i, h), []))
            rows.append((i, len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "ignore")] * with_text))
        own = {n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))}
        return pa.table(own | {c: left.column(f"__{c}") for c in carry})

    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)
    schema = T.StructType([*schema.fields, *(docs.schema[c] for c in carry)])
    return base.withColumn("grp", grp).mapInArrow(gather, "grp int, docs binary").groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(apply, schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What each document keeps without repeats of earlier ones; null texts are empty, an empty table gives no rows."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
