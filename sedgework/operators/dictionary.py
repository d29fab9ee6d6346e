"""Mentions of a dictionary of any size: texts are joined with a table of aliases by their first tokens, then scanned.

A token is a run of characters between edges (blanks and marks), or one edge. An alias matches where its text stands between edges;
at each place the longest one counts, and from left to right a place that a match took is taken. Nothing of the dictionary is
in the plan: it is a table (alias, skill, label), joined by hash or broadcast as its size allows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgework.functions import values as V
from sedgework.operators.entries import sure
from sedgework.sources.tables import dealt_out

TOKEN = f"{V.ALIAS_EDGE}|{V.ALIAS_EDGE.replace('[', '[^', 1)}+"
#: The same tokens in Python (white space as in Java), and all edges.
PATTERN = re.compile(TOKEN, re.ASCII)
EDGES = frozenset(re.findall(V.ALIAS_EDGE, "".join(map(chr, range(0x3000))), re.ASCII))
#: Tokens of an alias that texts are joined by, hashes of tokens, rows of texts that are handled at once, what is found of a match.
HEAD = 3
SLOTS = 65_536
ROWS = 200
FOUND = ("at", "alias", "skill", "label", "rest", "before", "beyond")


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(lo, ROWS) for lo in range(0, b.num_rows, ROWS))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def aliases(dictionary: DataFrame) -> DataFrame:
    """(alias, skill, label, first, size) of a dictionary (alias, skill, label): lower case, blanks trimmed, of equal aliases the greatest skill."""
    rows = dictionary.select(F.lower(F.trim("alias")).alias("alias"), "skill", F.coalesce("label", "skill").alias("label")).where("alias <> '' AND skill IS NOT NULL")
    one = rows.groupBy("alias").agg(F.max(F.struct("skill", "label")).alias("s"))
    return one.select("alias", "s.skill", "s.label", F.get(tokens(F.col("alias")), 0).alias("first"), F.size(tokens(F.col("alias"))).alias("size"))


class Roles(dict):
    """What a token may be, as bits: 1 an edge, then for each of the few sizes of a head the first and the last token of one.

    Of these only hashes modulo ``SLOTS`` are known (a bounded set), so a role may be wrongly given but is never left out.
    """

    def __init__(self, ends: dict[int, tuple[list[int], list[int]]]):
        super().__init__()
        self.sets = [frozenset(x) for first_last in ends.values() for x in first_last]

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        slot = crc32(token.encode()) % SLOTS
        self[token] = bits = (token in EDGES) + sum(2 << j for j, x in enumerate(self.sets) if slot in x)
        return bits


def heads(tokens_: list[str], roles: Roles, sizes: list[int]) -> set[str]:
    """What aliases that match in a text begin with: its runs of so many tokens at its start and behind edges, if an alias may have their first and last."""
    bits, out = np.fromiter(map(roles.__getitem__, tokens_), np.uint8, len(tokens_)), set()
    open_ = np.append(True, bits[:-1] & 1 > 0) if len(bits) else np.zeros(0, bool)
    for j, n in enumerate(sizes):
        may = open_[: max(0, len(bits) - n + 1)] & (bits[: max(0, len(bits) - n + 1)] & 2 << 2 * j > 0) & (bits[n - 1 :] & 4 << 2 * j > 0)
        out.update("".join(tokens_[i : i + n]) for i in np.flatnonzero(may).tolist())
    return out


def scan(tokens_: list[str], sizes: dict[str, int]) -> Iterator[tuple[int, str, int]]:
    """(place, alias, size) of the matches from left to right, the longest of each place; ``sizes``: tokens of the aliases that may be there."""
    of_first: dict[str, set[int]] = {}
    for alias, size in sizes.items():
        of_first.setdefault(PATTERN.match(alias)[0], set()).add(size)
    longest_first = {t: sorted(x, reverse=True) for t, x in of_first.items()}
    end = 0
    for i in compress(range(len(tokens_)), map(longest_first.__contains__, tokens_)):
        if i < end or i and tokens_[i - 1] not in EDGES:
            continue
        for size in longest_first[tokens_[i]]:
            alias, stop = "".join(tokens_[i : i + size]), i + size
            # a run of tokens is followed by an edge, only behind an edge anything may follow
            if sizes.get(alias) == size and (stop >= len(tokens_) or tokens_[stop - 1] not in EDGES or tokens_[stop] in EDGES):
                yield i, alias, size
                end = stop
                break


def matches(df: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, at, alias, skill, label, rest, near): all matches, ``at`` the number of their first token.

    ``rest`` is what follows (some tokens), ``near`` the word on the other side of a slash beside the match. Null texts have none.
    The heads of a text (once each, not at every place) are joined with those of the dictionary, so that each text meets
    only aliases that begin as something in it does; the texts themselves are shuffled once.
    """
    known = aliases(dictionary)
    slot = lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(SLOTS)).cast("int")
    begin = F.slice(tokens(F.col("alias")), 1, HEAD)
    known = known.withColumn("begin", begin).withColumn("head", F.array_join("begin", ""))
    # some numbers for each of the few sizes, however large the dictionary is
    sized = known.groupBy(F.size("begin").alias("n")).agg(F.max("size").alias("longest"), F.collect_set(slot(F.col("first"))).alias("first"), F.collect_set(slot(F.element_at("begin", -1))).alias("last")).collect()
    ahead, ends = max((r["longest"] for r in sized), default=1) + 4, {r["n"]: (r["first"], r["last"]) for r in sized}
    known = known.drop("begin")
    # equal structs also where the key is null
    texts = dealt_out(df.where(F.col(text).isNotNull()).select(F.struct(key).alias("k"), F.lower(text).alias("low")), "k")
    k = texts.schema["k"]

    def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roles, sizes = Roles(ends), list(ends)
        for part in parts(batches):
            found = [heads(PATTERN.findall(t), roles, sizes) for t in part.column(1).to_pylist()]
            row = pa.array([n for n, x in enumerate(found) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), pa.array(list(chain.from_iterable(found)), pa.string())], names=["k", "head"])

    begun = texts.mapInArrow(heads_of, T.StructType([k, T.StructField("head", T.StringType())]))
    may = begun.join(known, "head").groupBy("k").agg(F.collect_list(F.struct("alias", "size", "skill", "label")).alias("may"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            row, out = [], []
            for n, (low, given) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                toks, by = PATTERN.findall(low), {x["alias"]: x for x in given}
                get = lambda i: toks[i] if i >= 0 else None  # noqa: B023, E731
                for i, alias, size in scan(toks, {a: x["size"] for a, x in by.items()}):
                    row.append(n)
                    out.append((i, alias, by[alias]["skill"], by[alias]["label"], "".join(toks[i + size : i + ahead]), get(i - 1), get(i - 2)))
            columns = [pa.array([r[j] for r in out], pa.int32() if name == "at" else pa.string()) for j, name in enumerate(FOUND)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *columns], names=["k", *FOUND])

    kinds = [T.StructField(name, T.IntegerType() if name == "at" else T.StringType()) for name in FOUND]
    hit = texts.join(may, "k").select("k", "low", "may").mapInArrow(scanned, T.StructType([k, *kinds]))
    beside = F.when(F.col("before") == "/", F.regexp_extract("beyond", "([a-z0-9#+]+)$", 1)).when(F.col("rest").startswith("/"), F.regexp_extract("rest", "^/[^a-z0-9#+]*([a-z0-9#+.]+)", 1))
    return hit.select(F.col("k")[key].alias(key), "at", "alias", "skill", "label", "rest", F.nullif(beside, F.lit("")).alias("near"))


def mentions(df: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, skill, n, label): how often each text mentions each skill."""
    return matches(df, key, text, dictionary).groupBy(key, "skill").agg(F.count("*").alias("n"), F.max("label").alias("label"))


def terms(df: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, skill, label, at): the skills that a posting asks for, by their first place, without doubtful matches.

    An alias of one or two characters beside a slash counts only if the word on the other side is an alias too; a phrase
    that ends in -ing and takes an object (an article or the like behind it) is a verb.
    """
    found = matches(df, key, text, dictionary).withColumn("short", (F.length("alias") <= V.SHORT_ALIAS) & F.col("near").isNotNull())
    # only short aliases ask for their neighbour; others are dealt by their place, so that they don't meet in one task
    found = found.withColumn("near", F.when(F.col("short"), F.col("near")).otherwise(F.concat(F.lit("\n"), "at")))
    known = aliases(dictionary).select(F.col("alias").alias("near"), F.lit(True).alias("__known"))
    found = found.join(known, "near", "left")
    foreign = F.col("short") & F.col("__known").isNull()
    last = F.substring_index("alias", " ", -1)
    verb = F.col("alias").contains(" ") & last.endswith("ing") & F.regexp_extract("rest", "^\\s+([a-z']+)", 1).isin(*V.OBJECT_OPENERS)
    return found.where(~sure(foreign) & ~sure(verb)).groupBy(key, "skill").agg(F.max("label").alias("label"), F.min("at").alias("at"))
