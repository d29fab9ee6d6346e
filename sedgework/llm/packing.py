"""Best-fit packing by a configuration linear program.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Only the histogram of
piece lengths (``capacity`` numbers, whatever the input) goes to the driver. There the configuration
program, minimise sum(x_c) so that sum(x_c * count of length l in c) >= pieces of length l, is
solved by multiplicative weights: each round a knapsack dynamic program finds the configuration of
largest weight, which is used a little, and the weights of the lengths it covers shrink. The solution
is rounded down; what is left is placed best fit, longest first, on the histogram. The pieces then
get their places by a rank among those of their length, counted in salted chunks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgework.llm.common import held, slices, table, tidied, written

LETTERS = "a-zªµºß-öø-ʯ"
DIGITS = "0-9²³¹¼½¾"
#: The pattern of the vocabulary's own pre-tokenizer, for lower-case text of the characters in PLAIN.
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")
#: Characters for which the split above equals the tokenizer's; a text with others goes to the tokenizer whole.
OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-ʯ‐-‧€]")
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


@dataclass(frozen=True)
class Settings:
    """``schedules``: (sharpness, step, most rounds) of the multiplicative weights; each solution's ``shares`` are rounded."""

    capacity: int = 2048
    end_id: int = 0
    schedules: tuple[tuple[float, float, int], ...] = ((0.1, 0.35, 400), (30.0, 0.02, 600))
    chunk_rows: int = 200_000
    shares: tuple[float, ...] = (1.0, 0.9, 0.75, 0.5, 0.0)


class Tokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes, by word.

    The vocabulary's merges never cross a word of the pre-tokenizer, so each distinct word is encoded
    once and remembered.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores; further threads only take memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        """The number of each known word, and of each number where its ids begin and end."""
        self.number: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, "<u4"), np.zeros(1, np.int64)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Remember the ids of new words: one call for all, blanks between, told apart by their place in it."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, of = np.array(found.ids, "<u4"), np.array(found.word_ids)
        ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
        if len(ends) != len(words):  # a word that the tokenizer splits further
            each = [np.frombuffer(self.whole(w), "<u4") for w in words]
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        held = int(self.ends[-1])
        if held + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), "<u4")))
        self.ids[held : held + len(ids)] = ids
        self.ends = np.concatenate((self.ends, held + ends))
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.number) > 500_000:
            self.forget()
        out: list[bytes] = [b""] * len(texts)
        split, words, count = [], [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if OTHER.search(t) or "<|" in t and SPECIAL.search(t):
                out[i] = self.whole(t)
            else:
                found = SPLIT.findall(t.lower())
                words += found
                split.append(i)
                count.append(len(found))
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0).tolist()
        if new:
            fresh = sorted({words[k] for k in new})
            for at in range(0, len(fresh), 500):
                self.learn(fresh[at : at + 500])
            number[new] = [self.number[words[k]] for k in new]
        size = self.ends[number + 1] - self.ends[number]
        last = np.cumsum(size)
        ids = self.ids[np.repeat(self.ends[number] - last + size, size) + np.arange(int(last[-1]) if len(last) else 0)]
        at = np.append(0, last)[np.cumsum([0, *count])].tolist()
        for i, lo, hi in zip(split, at, at[1:], strict=False):
            out[i] = ids[lo:hi].tobytes()
        return out


def pieces(docs: DataFrame, path: str, settings: Settings) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the documents; a null text is empty."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    end = np.array([settings.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = held(("tokens", path), lambda: Tokens(path))
        for b in tidied(w.slice(at, 2_000) for w in batches for at in range(0, w.num_rows, 2_000)):
            ids, texts = (c.to_pylist() for c in b.columns)
            for part in slices([len(t) if t else 0 for t in texts], 1_000_000):
                out = []
                for i, raw in zip(ids[part], tokens(texts[part]), strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * settings.capacity)):
                        cut = raw[at : at + 4 * settings.capacity]
                        out.append((i, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def price(value: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of largest total value: knapsack by dynamic programming. ``value[l]`` <= 0: length not in use.

    Few lengths are taken one after another, each in chunks as wide as it is; many are compared at each capacity.
    """
    lengths = np.flatnonzero(value > 0)
    v = value[lengths]
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    if (capacity // lengths).sum() < capacity // 2:
        for length, worth in zip(lengths[::-1].tolist(), v[::-1].tolist(), strict=True):
            for at in range(length, capacity + 1, length):
                top = min(at + length, capacity + 1)
                got = best[at - length : top - length] + worth
                more = got > best[at:top]
                best[at:top][more], choice[at:top][more] = got[more], length
        c = int(best.argmax())
    else:
        fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            if n := fits[c]:
                got = best[c - lengths[:n]] + v[:n]
                k = int(got.argmax())
                if got[k] > best[c]:
                    best[c], choice[c] = got[k], lengths[k]
        c = capacity
    out: dict[int, int] = {}
    while c > 0:
        if choice[c]:
            out[int(choice[c])] = out.get(int(choice[c]), 0) + 1
            c -= int(choice[c])
        else:
            c -= 1
    return out


def configurations(counts: np.ndarray, settings: Settings, sharpness: float, step: float, rounds: int) -> dict[tuple, float]:
    """Fractional uses of configurations, by multiplicative weights over the lengths.

    A length is worth its tokens at first, and less by ``exp(-sharpness)`` when all of it is covered; a
    covered length is worth nothing. Each round the best configuration covers ``step`` of one of its lengths.
    """
    need = counts.astype(np.float64)
    left, size = need.copy(), np.arange(len(need)) / settings.capacity
    out: dict[tuple, float] = {}
    for _ in range(rounds):
        open_ = left > 0.5
        if not open_.any():
            break
        covered = 1 - left / np.maximum(need, 1)
        config = price(np.where(open_, size * np.exp(-sharpness * (covered - covered[open_].min())), 0), settings.capacity)
        lengths, times = np.array(list(config)), np.array(list(config.values()))
        use = min((left[lengths] / times).min(), max(1.0, step * ((need if sharpness > 1 else left)[lengths] / times).max()))
        key = tuple(sorted(config.items()))
        out[key] = out.get(key, 0) + use
        left[lengths] -= use * times
    return out


def best_fit(counts: np.ndarray, capacity: int, begun: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, of a histogram: (configuration, how many). ``begun`` sequences are filled up."""
    open_: dict[int, dict[tuple, int]] = {}

    def add(config: dict[int, int], many: int) -> None:
        room = capacity - sum(length * k for length, k in config.items())
        key = tuple(config.items())
        open_.setdefault(room, {})
        open_[room][key] = open_[room].get(key, 0) + many

    for config, many in begun:
        add(config, many)
    for length in range(len(counts) - 1, 0, -1):
        n = int(counts[length])
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            if room is not None:
                key, many = next(iter(open_[room].items()))
                each = min(room // length, n)  # the same length again is the best fit while it fits
                if room - length >= length and any(length <= r < room - length for r in open_):
                    each = 1
                use = min(many, n // each)
                open_[room][key] -= use
                if not open_[room][key]:
                    del open_[room][key]
                if not open_[room]:
                    del open_[room]
            else:
                key, each = (), min(capacity // length, n)
                use = n // each
            config = dict(key)
            config[length] = config.get(length, 0) + each
            add(config, use)
            n -= use * each
    return [(dict(key), many) for room in sorted(open_) for key, many in open_[room].items()]


def rounded(uses: list[tuple[tuple, float]], counts: np.ndarray, share: float, capacity: int) -> list[tuple[dict[int, int], int]]:
    """A share of the fractional uses, rounded down; what is left of the histogram is placed best fit, in their gaps too."""
    left = counts.astype(np.int64).copy()
    chosen: list[tuple[dict[int, int], int]] = []
    for key, x in uses:
        n = min([int(x * share + 1e-9), *(int(left[length]) // k for length, k in key)])
        if n:
            chosen.append((dict(key), n))
            for length, k in key:
                left[length] -= n * k
    return best_fit(left, capacity, chosen)


def plan(counts: np.ndarray, settings: Settings) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, past the last rank, pieces per sequence, first sequence, offset of the first).

    Of the roundings of the fractional solutions (all of their uses, a part, or none: plain best fit) the
    one of fewest sequences.
    """
    fewest, chosen = np.inf, []
    least = -(-int((np.arange(len(counts)) * counts).sum()) // settings.capacity)
    for sharpness, step, rounds in settings.schedules:
        if fewest == least:  # no packing has fewer
            break
        uses = sorted(configurations(counts, settings, sharpness, step, rounds).items(), key=lambda kx: (-kx[1], kx[0]))
        for share in settings.shares:
            found = rounded(uses, counts, share, settings.capacity)
            if (n := sum(n for _, n in found)) < fewest:
                fewest, chosen = n, found
            if fewest == least:
                break
    rank, sequence, rows = np.zeros(len(counts), np.int64), 0, []
    for config, n in chosen:
        offset = 0
        for length, k in config.items():
            first = int(rank[length])
            rows.append((length, first, first + n * k, k, sequence, offset))
            rank[length] += n * k
            offset += length * k
        sequence += n
    return rows


def pack(docs: DataFrame, path: str, settings: Settings = Settings()) -> DataFrame:
    """Pack the texts of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Every row of
    ``docs`` is packed, repeated ones and those of a null doc_id or text too (an empty text is its end
    id alone). An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, path, settings))
    histogram = cut.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(settings.capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    chunks = max(1, -(-int(counts.sum()) // settings.chunk_rows))
    # a rank among the pieces of a length: within a chunk by a window, chunks one after another by their counts
    salted = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(chunks, 16))).cast("int"))
    per_chunk = salted.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = per_chunk.select("length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("within", within).join(before, ["length", "chunk"]).withColumn("rank", F.col("within") + F.col("before"))
    rows = plan(counts, settings)
    # at most (all schedules' rounds + a multiple of capacity) configurations, whatever the input
    places = spark.createDataFrame(pd.DataFrame(rows, columns=["at_length", "first", "past", "each", "sequence", "base"]), "at_length long, first long, past long, each long, sequence long, base long")
    here = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(places), (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(here / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + here % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences; an empty text is its end token, an empty table gives no rows."""
    return pack(table(spark, sf_dir, "documents"), vocabulary())
