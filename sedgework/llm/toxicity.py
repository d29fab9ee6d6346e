"""Toxicity by a factorization machine over hashed terms.

A document is a set of hashed terms: its lower-cased words and their stems of four to six letters.
The model is ``b + sum_i w_i + sum_{i<j} <v_i, v_j>`` over the terms present, so a pair such as an
insult beside a group mention has a weight of its own. It is fitted on the driver on a bounded
sample of labelled rows; scoring reads each document once and shuffles nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.llm.common import Bounded, by_text, forget, remainder, segments, slices, table, tidied, written

WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that are fitted on; rows are drawn by a hash of their id."""

    sample_rows: int = 16_000
    hash_bits: int = 24
    min_documents: int = 3
    min_chi2: float = 11.0
    max_terms: int = 2048
    factors: int = 8
    epochs: int = 16
    batch: int = 512
    rate: float = 0.03
    shrink: float = 2e-4
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """``terms``: sorted hashes with a weight; everything else has weight 0."""

    bits: int
    terms: np.ndarray
    bias: float
    linear: np.ndarray
    pairs: np.ndarray


def hashed(word: str, bits: int) -> tuple[int, ...]:
    """The hashes of a word and of its stems."""
    shift = 32 - bits
    out = [zlib.crc32(b"w:" + word.encode("utf-8", "surrogatepass")) >> shift]
    out += [zlib.crc32(b"s:" + word[:n].encode("utf-8", "surrogatepass")) >> shift for n in (4, 5, 6) if len(word) >= n]
    return tuple(out)


def term_rows(rows: DataFrame, settings: Settings) -> DataFrame:
    """(label, terms) of rows (text, label): the distinct hashes of each text."""
    bits = settings.hash_bits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Bounded(lambda w: hashed(w, bits))
        for b in tidied(batches):
            found = [sorted({h for w in set(WORDS.findall((t or "").lower())) for h in known[w]}) for t in b["text"]]
            yield pd.DataFrame({"label": b["label"], "terms": found})

    return rows.mapInPandas(run, "label int, terms array<int>")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings, of: Column | None = None) -> Model | None:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic) joined to ``docs`` (doc_id, text).

    ``of`` says which ids may be learned from. None if there are no labels of both classes.
    """
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if of is not None:
        labels = labels.where(of)
    count = labels.count()
    if not count:
        return None
    # the same rule on both sides, so that only the sample is shuffled
    share = min(1.0, settings.sample_rows / count)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 50)) < F.lit(max(1, int(share * (1 << 50))))
    one = labels.where(drawn).groupBy("doc_id").agg(F.max("label").alias("label"))  # toxic where repeated labels disagree
    sample = docs.select("doc_id", "text").where(drawn).join(one, "doc_id").select("text", "label")
    rows = written(term_rows(sample, settings))
    counts = rows.groupBy().agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    n, pos = counts["n"] or 0, counts["pos"] or 0
    if not pos or pos == n:
        return None
    a, b = F.col("pos"), F.col("all") - F.col("pos")
    c, d = F.lit(float(pos)) - a, F.lit(float(n - pos)) - b
    chi2 = F.lit(float(n)) * F.pow(a * d - b * c, 2) / (F.col("all") * (F.lit(float(n)) - F.col("all") + 1e-9) * F.lit(float(pos) * (n - pos)))
    by_term = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("pos"), F.count("*").alias("all"))
    chosen = by_term.where(F.col("all") >= settings.min_documents).withColumn("chi2", chi2).where(F.col("chi2") >= settings.min_chi2)
    terms = np.array(sorted(r["term"] for r in chosen.orderBy(F.desc("chi2"), "term").limit(settings.max_terms).select("term").collect()), np.int64)
    wanted = {int(t): i for i, t in enumerate(terms)}

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"label": x["label"], "ids": [[wanted[t] for t in found if t in wanted] for found in x["terms"]]})

    got = rows.mapInPandas(local, "label int, ids array<int>").toPandas()
    got = got.iloc[np.lexsort((got["ids"].map(str).to_numpy(str), got["label"]))]  # an order that doesn't depend on the cluster
    return train(got["ids"].tolist(), got["label"].to_numpy(np.float64), terms, settings)


def train(ids: list, y: np.ndarray, terms: np.ndarray, settings: Settings) -> Model:
    """Adam on the logistic loss; classes weigh the same in total."""
    n, f, k = len(ids), len(terms), settings.factors
    lengths = np.fromiter(map(len, ids), np.int64, n)
    flat, starts = np.fromiter((i for row in ids for i in row), np.int64, lengths.sum()), np.cumsum(lengths) - lengths
    rng = np.random.default_rng(5)
    p = {"b": np.zeros(1), "w": np.zeros(f), "v": rng.normal(0, 0.02, (f, k))}
    m, s = ({key: np.zeros_like(v) for key, v in p.items()} for _ in range(2))
    weight = np.sqrt(np.where(y > 0, n / (2 * y.sum()), n / (2 * (n - y.sum()))))
    step = 0
    for _ in range(settings.epochs):
        order = rng.permutation(n)
        for at in range(0, n, settings.batch):
            i = order[at : at + settings.batch]
            row, first, size = segments(starts[i], lengths[i], 1)
            x = flat[first]
            v = p["v"][x]
            total = np.stack([np.bincount(row, v[:, j], len(i)) for j in range(k)], 1)
            z = p["b"] + np.bincount(row, p["w"][x], len(i)) + 0.5 * (total**2).sum(1) - 0.5 * np.bincount(row, (v**2).sum(1), len(i))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(i)
            dv = g[row, None] * (total[row] - v)
            grad = {"b": np.array([g.sum()]), "w": np.bincount(x, g[row], f), "v": np.stack([np.bincount(x, dv[:, j], f) for j in range(k)], 1)}
            step += 1
            for key, got in grad.items():
                got = got + settings.shrink * p[key] * (key != "b")
                m[key] += 0.1 * (got - m[key])
                s[key] += 0.001 * (got**2 - s[key])
                p[key] -= settings.rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(s[key] / (1 - 0.999**step)) + 1e-8)
    return Model(settings.hash_bits, terms, float(p["b"][0]), p["w"].astype(np.float32), p["v"].astype(np.float32))


def score(docs: DataFrame, model: Model | None, settings: Settings = Settings()) -> DataFrame:
    """Add ``score`` (double, 0 to 1) and ``predicted`` (int) to ``docs`` by its column text.

    Null and empty texts, and all texts where there is no model, get the score of no terms (0 without
    a model). Repeated rows score alike; other columns, but for those two, stay as they are; very long texts are
    read whole; an empty table stays empty.
    """
    bias = model.bias if model else -np.inf
    at = {int(t): i for i, t in enumerate(model.terms)} if model else {}

    def maker():
        forget()
        find = Bounded(lambda w: tuple(at[h] for h in hashed(w, model.bits) if h in at))

        def run(texts: list) -> dict:
            scores = []
            for part in slices([len(t) if t else 0 for t in texts], 4_000_000) if at else ():
                ids, ends = [], []
                for t in texts[part]:
                    found = set()
                    for w in set(WORDS.findall(t.lower())) if t else ():
                        if hit := find[w]:
                            found.update(hit)
                    ids += sorted(found)
                    ends.append(len(ids))
                rows = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
                w, v = model.linear[ids].astype(np.float64), model.pairs[ids].astype(np.float64)
                z = bias + np.bincount(rows, w, len(ends))
                for j in range(v.shape[1]):
                    z += 0.5 * (np.bincount(rows, v[:, j], len(ends)) ** 2 - np.bincount(rows, v[:, j] ** 2, len(ends)))
                scores.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
            got = np.concatenate(scores) if scores else np.full(len(texts), 1 / (1 + np.exp(-bias)) if bias > -50 else 0.0)
            return {"score": got, "predicted": (got >= settings.threshold).astype(np.int32)}

        return run

    return by_text(docs, "text", maker, {"score": "double", "predicted": "int"})


def learnable(by: int = 3, held: int = 1) -> Column:
    return remainder(F.col("doc_id"), by) != held


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, by a machine fitted on labelled ones; without labels all scores are 0, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), Settings(), learnable())
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted")
