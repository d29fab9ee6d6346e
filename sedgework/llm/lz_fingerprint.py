"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into the phrases of an incremental dictionary (LZ78): each phrase is the longest one
known so far and one more character. Texts that compress each other share phrases, so the share of
equal MinHash values of two phrase sets is a likeness in the sense of compression.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgework.llm.common import by_text, code_points, mix64, slices, table, tidy, written
from sedgework.llm.jaccard_join import signatures

VALUES = 64
ODD = 0x9E3779B97F4A7C15


def phrase_ends(text: str, at: int, root: dict, node: dict, ends: list[int], added: list | None = None) -> dict:
    """Parse ``text`` from state ``node`` on; appends the end of each phrase, returns the state."""
    append = ends.append
    for i, ch in enumerate(text, at + 1):
        nxt = node.get(ch)
        if nxt is None:
            node[ch] = {}
            if added is not None:
                added.append((node, ch))
            append(i)
            node = root
        else:
            node = nxt
    return node


def closed(ends: list[int], n: int) -> list[int]:
    """The rest of a text behind its last phrase is a phrase too."""
    return ends if not n or ends and ends[-1] == n else [*ends, n]


def parse_both(text: str, tail: str | None) -> tuple[list[int], list[int] | None]:
    """Phrase ends of ``text``, and of its first part with ``tail`` behind it (what they share is parsed once)."""
    root: dict = {}
    half = len(text) - len(text) // 2
    ends: list[int] = []
    if tail is None:
        phrase_ends(text, 0, root, root, ends)
        return closed(ends, len(text)), None
    node = phrase_ends(text[:half], 0, root, root, ends)
    own, added = ends.copy(), []
    phrase_ends(text[half:], half, root, node, own, added)
    for where, ch in reversed(added):
        del where[ch]
    phrase_ends(tail, half, root, node, ends)
    return closed(own, len(text)), closed(ends, half + len(tail))


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    inverse = pow(ODD, -1, 1 << 64)
    one = np.ones(n, np.uint64)
    up, down = one.copy(), one.copy()
    up[1:], down[1:] = np.uint64(ODD), np.uint64(inverse)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def phrase_hashes(texts: list[str], ends: list[list[int]]) -> list[np.ndarray]:
    """A 64-bit hash of each phrase of each text, from sums of code points times powers."""
    codes, lengths = code_points(texts)
    size = 1 << max(16, int(lengths.max(initial=0)).bit_length())
    up, down = powers(size)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[place], dtype=np.uint64)))
    out = []
    for at, e in zip(starts, ends, strict=True):
        end = np.array(e, np.int64)
        begin = np.concatenate(([0], end[:-1])) if len(end) else end
        out.append(mix64((sums[at + end] - sums[at + begin]) * down[begin] + (end - begin).astype(np.uint64)))
    return out


def sketches(texts: list[str], ends: list[list[int]]) -> np.ndarray:
    """Sixteen bits of each MinHash value of each text's phrases; all ones for no phrases."""
    out = np.full((len(texts), VALUES), 0xFFFF, np.uint16)
    some = [i for i, e in enumerate(ends) if e]
    if some:
        hashes = phrase_hashes([texts[i] for i in some], [ends[i] for i in some])
        out[some] = (signatures(hashes, VALUES) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)
    return out


def hexed(sketch: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in sketch.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal values, row by row."""
    return (a == b).mean(1)


def fingerprints(docs: DataFrame, column: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint (256 hexadecimal digits) of a text column; a null text has that of an empty one."""

    def maker():
        def run(texts: list) -> dict:
            out: list[str] = []
            for part in slices([len(t) if t else 0 for t in texts], 2_000_000):
                some = [t or "" for t in texts[part]]
                out += hexed(sketches(some, [parse_both(t, None)[0] for t in some]))
            return {name: out}

        return run

    return by_text(docs, column, maker, {name: "string"})


RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(ids: list, texts: list[str], after: str) -> list[pa.Array]:
    """Results for consecutive documents; ``after`` is the text behind the last of them."""
    following = [*texts[1:], after]
    own, edited, edited_texts = [], [], []
    for t, nxt in zip(texts, following, strict=True):
        n = len(t) // 2
        tail = nxt[:n]
        a, b = parse_both(t, tail)
        own.append(a)
        edited.append(b)
        edited_texts.append(t[: len(t) - n] + tail)
    mine = sketches([*texts, after], [*own, parse_both(after, None)[0]])
    changed = sketches(edited_texts, edited)
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited_texts]
    columns = [ids, list(map(len, texts)), sha, hexed(mine[:-1]), hexed(changed), likeness(mine[:-1], changed), likeness(mine[:-1], mine[1:])]
    return [pa.array(c, kind) for c, kind in zip(columns, KINDS, strict=True)]


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint each text of ``docs`` (doc_id, text), an edited copy of it, and compare with the next document.

    The next document is that of the next smaller doc_id (nulls last, ties by the text's hash), for the last
    one the first. The documents are range-partitioned by id; only the first and last document of
    each partition meet again in a join, by the partition's rank. Repeated rows are documents of their own; an empty
    table gives no rows; other columns are not read.
    """
    names = [*RESULT, "kind", "pid", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the dictionaries of the parse hold no cycles
        pid, held = TaskContext.get().partitionId(), None
        for b in (w.slice(at, 2_000) for w in batches for at in range(0, w.num_rows, 2_000)):
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            if held is None and ids:
                yield whole(None, 1, pid, texts[0])
            elif ids:
                ids, texts = [held[0], *ids], [held[1], *texts]
            for part in slices(list(map(len, texts[:-1])), 2_000_000):
                rows = compared(ids[part], texts[part], texts[part.stop])
                n = len(rows[0])
                yield pa.RecordBatch.from_arrays([*rows, pa.array([0] * n, pa.int32()), pa.array([pid] * n, pa.int32()), pa.nulls(n, pa.string())], names=names)
            if ids:
                held = ids[-1], texts[-1]
        if held:
            yield whole(held[0], 2, pid, held[1])
        gc.enable()
        tidy()

    def whole(i, kind: int, pid: int, text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *(pa.nulls(1, k) for k in KINDS[1:]), pa.array([kind], pa.int32()), pa.array([pid], pa.int32()), pa.array([text], pa.string())], names=names)

    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    sorted_ = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    out = written(sorted_.mapInArrow(run, SCHEMA + ", kind int, pid int, text string"))
    # as many rows as partitions, without the texts
    ranks = out.where("kind = 1").select("pid").withColumn("rank", F.row_number().over(Window.orderBy("pid")) - 1).withColumn("of", F.count("*").over(Window.partitionBy()))
    last = out.where("kind = 2").select("doc_id", "text", "pid").join(ranks, "pid").withColumn("at", (F.col("rank") + 1) % F.col("of"))
    first = out.where("kind = 1").select(F.col("text").alias("after"), "pid").join(ranks, "pid").select("after", F.col("rank").alias("at"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text, after in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_arrays(compared([i], [text], after), names=RESULT)

    closing = last.join(first, "at").select("doc_id", "text", "after").mapInArrow(ends, SCHEMA)
    return out.where("kind = 0").select(*RESULT).unionByName(closing)


def op9_lz_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; one document alone is its own next, an empty table gives no rows."""
    return edit_fingerprints(table(spark, sf_dir, "documents"))
