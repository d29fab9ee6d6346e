"""Language identification and toxicity: held-out accuracy, and rows of every odd kind."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from sedgework.llm import langid, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "en"), (2, "", "en"), (3, "12 34 !", "en"), (4, "the and of the and", None), (4, "the and of the and", None), (5, "the of " * 20_000, "en")]


@pytest.fixture(scope="module")
def predicted(spark):
    return langid.op1_language_id(spark, SF).toPandas() if hasattr(langid, "op1_language_id") else None


def query(prefix: str):
    from sedgework.llm.queries import QUERIES

    return next(f for n, f in QUERIES.items() if n.startswith(prefix))


def test_language_held_out(spark):
    got = query("op1_")(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    both = got.merge(docs[["doc_id", "text", "lang"]], on="doc_id")
    assert [bool(h) for h in both["held_out"]] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both["doc_id"]]
    known = both[both["held_out"] & both["lang"].notna() & (both["lang_pred"] != "und")]
    assert (known["lang"] == known["lang_pred"]).mean() > 0.8
    assert both["score"].between(0, 1).all()
    letterless = both[[t is None or not any(c.isalpha() for c in t) for t in both["text"]]]
    assert set(letterless["lang_pred"]) <= {"und"}


def test_language_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumn("extra", F.lit("x"))
    samples = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"), langid.Settings(), langid.learnable())
    got = langid.predict(docs, samples).toPandas()
    assert len(got) == len(ODD) and "extra" in got.columns
    of = dict(zip(got["doc_id"], got["lang_pred"], strict=True))
    assert of[1] == of[2] == of[3] == "und" and of[4] == of[5] == "en"
    assert langid.predict(docs.limit(0), samples).count() == 0


SCRIPTS = {"en": (0x61, 26), "ru": (0x430, 32), "am": (0x1200, 70), "zh": (0x4E00, 900), "ja": (0x6000, 900), "ko": (0xAC00, 900), "egy": (0x30000, 300)}


def text_in(lang: str, seed: int, words: int = 60) -> str:
    rng, (first, n) = random.Random(f"{lang}{seed}"), SCRIPTS[lang]
    return " ".join("".join(chr(first + int(n * rng.random() ** 3)) for _ in range(rng.randint(2, 5))) for _ in range(words))


def test_language_of_many_scripts(spark):
    """Letters of all scripts are told apart, by the table and by the hash table alike."""
    docs = [(i * 10 + k, text_in(lang, i), lang) for i in range(30) for k, lang in enumerate(SCRIPTS)]
    # a few Latin letters in each sample, of which alone an automaton could be built
    docs += [(1000 + k, "the page of " * 5 + text_in(lang, 99), lang) for k, lang in enumerate(SCRIPTS)]
    held = [(5000 + i * 10 + k, text_in(lang, 500 + i, 8), lang) for i in range(6) for k, lang in enumerate(SCRIPTS)]
    schema = "doc_id long, text string, lang string"
    samples = langid.learn(spark.createDataFrame(docs, schema), langid.Settings())
    both = []
    for settings in (langid.Settings(), langid.Settings(dense_bytes=0)):
        got = langid.predict(spark.createDataFrame(held, schema), samples, settings).toPandas()
        assert (got["lang"] == got["lang_pred"]).all()
        both.append(got[["doc_id", "lang_pred", "score"]])
    assert both[0].equals(both[1])


def test_all_languages_are_learned(spark):
    docs = [(i, chr(0x4E00 + 3 * i) * 9 + " abc", f"l{i}") for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.learn(df, langid.Settings())).toPandas()
    assert (got["lang"] == got["lang_pred"]).all()


def test_toxicity_held_out(spark):
    got = query("op5_")(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    assert [bool(h) for h in got["held_out"]] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]
    assert ((got["score"] >= 0.7).astype(int) == got["predicted"]).all()
    assert ((held["score"] >= 0.7) == (held["toxic"] == 1)).mean() > 0.9


def test_toxicity_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, toxicity.Settings(), toxicity.learnable())
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumn("extra", F.lit("x"))
    got = toxicity.score(odd, model).toPandas()
    assert len(got) == len(ODD) and got["score"].between(0, 1).all() and "extra" in got.columns
    same = got[got["doc_id"] == 4]["score"]
    assert same.nunique() == 1
    assert toxicity.score(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("dense_bytes", [1 << 30, 0])
def test_phrases_against_brute_force(dense_bytes):
    """Texts of many blocks have the phrases of a letter by letter parse, by table and by hash table."""
    rng = random.Random(7)
    word = lambda k: "".join(rng.choices("abcde", k=k))
    samples = tuple((name, " ".join(word(rng.randint(1, 9)) for _ in range(60))) for name in ("x", "y", "z"))

    def count(text: str, sample: str) -> int:
        n, match = 1, ""
        for c in text:
            if match + c in sample:
                match += c
            else:
                n, match = n + 1, c if c in sample else ""
        return n

    texts = [" ".join(word(rng.randint(1, 9)) for _ in range(rng.randint(1, 40))) for _ in range(30)] + [samples[0][1], "qq", "a" * 200]
    _, class_of, moves, _ = langid.parser(samples, dense_bytes)
    codes, lengths = langid.code_points(texts)
    cls = class_of[codes].astype(int)
    for block in (1, 3, 7, 1024):
        doc, first, size = langid.segments(lengths.cumsum() - lengths, lengths, block)
        found = langid.phrases(moves, cls.astype("int32"), doc, first, size)
        for k, (_, sample) in enumerate(samples):
            got = [1 + int(found[k][doc == i].sum()) for i in range(len(texts))]
            assert got == [count(t, sample) for t in texts]


def test_language_of_many_labels(spark):
    """Seventy labels are all learned; columns of the new names are replaced."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices([f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}" for c in "uvwxyz"], k=80)), f"l{i:02d}") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    got = langid.predict(df, langid.learn(df, langid.Settings())).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 69
    assert langid.learn(df.limit(0), langid.Settings()) == ()


def test_toxicity_of_a_pair(spark):
    """Two words that are harmless alone; repeated labels that disagree count as toxic; clashing columns are replaced."""
    rng = random.Random(2)
    filler = [f"w{k}" for k in range(40)]
    rows, labels = [], []
    for i in range(1200):
        a, b = i % 4 in (1, 3), i % 4 in (2, 3)
        rows.append((i, " ".join(rng.choices(filler, k=12) + ["alpha"] * a + ["beta"] * b)))
        labels.append((i, int(a and b)))
    labels.append((3, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("predicted", F.lit("clash"))
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.Settings(), toxicity.learnable())
    got = toxicity.score(docs, model).collect()
    wrong = sum((r.predicted == 1) != (r.doc_id % 4 == 3) for r in got)
    assert wrong <= 12


def test_scores_are_those_of_a_plain_machine(spark):
    """Every score against the sum over all pairs of a text's terms, by hand; odd rows too."""
    import math

    import numpy as np

    from sedgework.llm import toxicity as tx

    rng = np.random.default_rng(5)
    words = [f"word{k}" for k in range(40)]
    terms = np.unique([h for w in words[:30] for h in tx.hashed(w, 24)])
    model = tx.Model(24, terms, -0.5, rng.normal(size=len(terms)).astype(np.float32), rng.normal(size=(len(terms), 4)).astype(np.float32) * 0.3)
    rows = [(k, " ".join(rng.choice(words, rng.integers(0, 15)))) for k in range(120)] + [(998, None), (999, ""), (1000, "WORD3, word3! word7 " * 3000)]
    got = {r.doc_id: (r.score, r.predicted) for r in tx.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    at = {int(t): i for i, t in enumerate(terms)}
    for k, text in rows:
        ids = sorted({at[h] for w in set(tx.WORDS.findall((text or "").lower())) for h in tx.hashed(w, 24) if h in at})
        z = model.bias + sum(float(model.linear[i]) for i in ids) + sum(float(np.dot(model.pairs[i].astype(float), model.pairs[j].astype(float))) for n, i in enumerate(ids) for j in ids[n + 1 :])
        want = 1 / (1 + math.exp(-z))
        assert abs(got[k][0] - want) < 1e-6 and got[k][1] == (got[k][0] >= 0.7)
