"""Measures of quality: rates, precision and recall, similarity, alignment, diffs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgework.functions import text as X
from sedgework.functions import values as V


def confusion(df: DataFrame, predicted: Column, actual: Column, group: str) -> DataFrame:
    """Counts, precision and recall of each group and of all (group ``ALL``); undefined shares are null."""
    p, a = predicted.alias("p"), actual.alias("a")
    rows = df.select(F.col(group).alias("grp"), p, a)
    n = lambda c: F.count(F.when(c, 1))
    out = rows.rollup("grp").agg(
        F.grouping("grp").alias("__all"), n(F.col("p") & F.col("a")).alias("matched"), n(F.col("p")).alias("predicted"), n(F.col("a")).alias("expected"), F.count("*").alias("n")
    )
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y))
    return out.select(F.when(F.col("__all") == 1, "ALL").otherwise(F.coalesce("grp", F.lit("none"))).alias("grp"), "matched", "predicted", "expected", "n", share("matched", "predicted").alias("precision"), share("matched", "expected").alias("recall"))


def rates(df: DataFrame, keys: list[str], criteria: dict[str, Column], when: dict[str, Column] | None = None) -> DataFrame:
    """Share of rows that meet each criterion; a criterion with a condition counts only the rows that meet that.

    A conditional rate without rows is null and takes no part in ``aggregate``, the mean of the rates.
    """
    when = when or {}
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.when(when.get(k, F.lit(True)), F.when(c, 1.0).otherwise(0.0))).alias(k) for k, c in criteria.items()])
    known = F.array_compact(F.array(*criteria))
    return out.withColumn("aggregate", F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def cold_and_warm(df: DataFrame, key: str, order: Column, value: str, failed: Column) -> DataFrame:
    """The first value of each key, the mean of the others (null if none), and the share of failures."""
    g = df.groupBy(key).agg(F.count("*").alias("runs"), F.min_by(F.col(value), order).alias("cold"), F.sum(value).alias("__sum"), F.avg(F.when(failed, 1.0).otherwise(0.0)).alias("failure_rate"))
    return g.withColumn("warm", F.when(F.col("runs") > 1, (F.col("__sum") - F.col("cold")) / (F.col("runs") - 1))).drop("__sum")


def multiset_dice(df: DataFrame, key: list[str], left: str, right: str) -> DataFrame:
    """Twice the shared words (with repeats) over all words of two texts; two empty texts are equal.

    Words are counted before they meet, so a long text sends one row for each different word.
    """
    words = lambda c: X.tokens(X.bullet_key(F.coalesce(F.col(c), F.lit(""))))
    base = df.select(*key, words(left).alias("__l"), words(right).alias("__r"))
    sizes = base.select(*key, F.size("__l").alias("nl"), F.size("__r").alias("nr"))
    each = base.select(*key, F.explode(F.concat(F.transform("__l", lambda w: F.struct(w.alias("w"), F.lit(1).alias("l"), F.lit(0).alias("r"))), F.transform("__r", lambda w: F.struct(w.alias("w"), F.lit(0).alias("l"), F.lit(1).alias("r"))))).alias("e"))
    counts = each.groupBy(*key, "e.w").agg(F.sum("e.l").alias("l"), F.sum("e.r").alias("r"))
    shared = counts.groupBy(*key).agg(F.sum(F.least("l", "r")).alias("shared"))
    both = F.col("nl") + F.col("nr")
    return sizes.join(shared, key, "left").select(*key, F.when(both == 0, F.lit(1.0)).otherwise(F.coalesce(F.col("shared"), F.lit(0)) * 2 / both).alias("dice"))


def numbers(text: Column) -> Column:
    """The different numbers of a text, sorted, without thousands' commas and closing points."""
    found = F.regexp_extract_all(text, F.lit("([0-9][0-9,.]*)"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.regexp_replace(F.replace(n, F.lit(","), F.lit("")), "[.]+$", ""))))


def number_changes(df: DataFrame, before: str, after: str) -> DataFrame:
    """``dropped`` and ``added`` numbers between two texts (comma-joined), and whether all are ``preserved``."""
    b, a = numbers(F.coalesce(F.col(before), F.lit(""))), numbers(F.coalesce(F.col(after), F.lit("")))
    out = df.withColumns({"dropped": F.array_join(F.array_sort(F.array_except(b, a)), ","), "added": F.array_join(F.array_sort(F.array_except(a, b)), ",")})
    return out.withColumn("preserved", (F.col("dropped") == "") & (F.col("added") == ""))


def words_of(line: str) -> list[str]:
    return re.sub(V.BULLET_MARKER, "", line).lower().split()


def dice(a: list[str], b: list[str]) -> float:
    if not a and not b:
        return 1.0
    left = {}
    for w in a:
        left[w] = left.get(w, 0) + 1
    shared = 0
    for w in b:
        if left.get(w, 0) > 0:
            left[w] -= 1
            shared += 1
    return 2 * shared / (len(a) + len(b))


def aligned(original: list[str], proposed: list[str], least: float = V.ALIGN_THRESHOLD) -> list[tuple[int | None, int | None]]:
    """Index pairs of an order-preserving alignment of largest summed similarity; pairs under ``least`` never form.

    Among equal sums a pair comes before a removal, a removal before an addition, read from the end.
    """
    a, b = [words_of(x) for x in original], [words_of(x) for x in proposed]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    pair = [[s if (s := dice(x, y)) >= least else None for y in b] for x in a]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = pair[i - 1][j - 1]
            best[i][j] = max(best[i - 1][j], best[i][j - 1], -1.0 if s is None else best[i - 1][j - 1] + s)
    out, i, j = [], len(a), len(b)
    while i or j:
        s = pair[i - 1][j - 1] if i and j else None
        if s is not None and best[i][j] == best[i - 1][j - 1] + s:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and (not j or best[i][j] == best[i - 1][j]):
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def align_lines(df: DataFrame, before: str, after: str) -> DataFrame:
    """Align the lines of two texts of a row: one row for each pair, with kind kept, changed, removed or added."""
    keep = [c for c in df.columns if c not in (before, after)]
    lines = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    schema = df.select(*keep).schema.add("kind", T.StringType()).add("original", T.IntegerType()).add("proposed", T.IntegerType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b = list(r[-2]), list(r[-1])
                for i, j in aligned(a, b):
                    kind = "added" if i is None else "removed" if j is None else "kept" if a[i] == b[j] else "changed"
                    rows.append((*r[:-2], kind, i, j))
            out = pd.DataFrame(rows, columns=schema.names)
            yield out.astype({"original": "Int32", "proposed": "Int32"})

    return df.select(*keep, lines(before).alias("__a"), lines(after).alias("__b")).mapInPandas(run, schema)


#: Characters of texts that are compared at once.
DIFF_CHARS = 500_000


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))
def word_diff(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Runs of equal, removed and added words and spaces that turn one text into the other.

    Rows are handed on in parts of a bounded size, as flat columns: a task holds no more of them, however many rows a batch has.
    """
    for before, after in batches:
        sizes = pc.add(*(pc.fill_null(pc.utf8_length(x), 0).cast(pa.int64()) for x in (before, after))).to_pylist()
        lo = 0
        while lo < len(sizes):
            hi, chars = lo + 1, sizes[lo]
            while hi < len(sizes) and chars + sizes[hi] <= DIFF_CHARS:
                chars += sizes[hi]
                hi += 1
            ends, kinds, texts = [0], [], []
            for a, b in zip(before.slice(lo, hi - lo).to_pylist(), after.slice(lo, hi - lo).to_pylist(), strict=True):
                for kind, t in changes(a, b):
                    kinds.append(kind)
                    texts.append(t)
                ends.append(len(kinds))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["kind", "text"]))
            lo = hi


def changes(a: str | None, b: str | None) -> Iterator[tuple[str, str]]:
    x, y = re.findall(r"\s+|\S+", a or ""), re.findall(r"\s+|\S+", b or "")
    for op, i, k, j, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            yield "same", "".join(x[i:k])
        else:
            yield from ((kind, t) for kind, t in (("removed", "".join(x[i:k])), ("added", "".join(y[j:m]))) if t)


def first_json(raw: str | None, opener: str = "{") -> str | None:
    """The first JSON value with this opener in a model's answer: as it is, without its fence, or the first balanced span that parses."""
    text = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", raw or "")
    decoder, at = json.JSONDecoder(), text.find(opener)
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            at = text.find(opener, at + 1)
    return None


@F.pandas_udf(T.StringType())
def repaired_json(raw: pd.Series) -> pd.Series:
    return pd.Series([first_json(x) for x in raw], dtype=object)


def pay_range(df: DataFrame, text: str) -> DataFrame:
    """The first pay range of a text: pay_min, pay_max and period (year, month or hour); nulls if none.

    A figure has a currency sign and may end in K (thousands); the period is named within the range's
    tail, and a year otherwise.
    """
    figure = "[$]\\s*([0-9][0-9,]*(?:[.][0-9]+)?)\\s*([Kk])?"
    pattern = f"{figure}\\s*(?:-|–|—|to)\\s*{figure}\\s*(?:/|per |an? )?\\s*(hour|hr|month|mo|year|yr)?"
    part = lambda k: F.regexp_extract(text, pattern, k)
    amount = lambda n, k: F.when(n != "", F.replace(n, F.lit(","), F.lit("")).cast("double") * F.when(k != "", 1000).otherwise(1))
    period = F.when(part(5).isin("hour", "hr"), "hour").when(part(5).isin("month", "mo"), "month").otherwise("year")
    low, high = amount(part(1), F.when(part(2) != "", part(2)).otherwise(part(4))), amount(part(3), part(4))
    return df.withColumns({"pay_min": low, "pay_max": high, "period": F.when(low.isNotNull(), period)})


def rows_of_items(df: DataFrame, gap: float = 3.5) -> DataFrame:
    """Cluster the items (doc_id, page, x, y, str) of each page into rows: adds ``row``, from the top.

    A row takes items until one is further than ``gap`` from its first item, so each cut depends on all
    items before: one sorted pass over each partition, which holds whole pages.
    """
    schema = df.select("*").schema.add("row", T.IntegerType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, row, anchor = None, -1, 0.0
        for pdf in batches:
            out = []
            for d, p, y in zip(pdf["doc_id"].tolist(), pdf["page"].tolist(), pdf["y"].tolist(), strict=True):
                if page != (d, p):
                    page, row, anchor = (d, p), 0, y
                elif abs(y - anchor) > gap:
                    row, anchor = row + 1, y
                out.append(row)
            yield pdf.assign(row=pd.Series(out, dtype="int32"))

    ordered = df.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", F.desc("y"), "x", "str")
    return ordered.mapInPandas(run, schema)
