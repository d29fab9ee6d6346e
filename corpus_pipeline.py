"""A training-corpus pipeline: toxicity, language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of
``documents`` (whatever further ones there are stay as they are); the last returns the packed pieces.
Null and empty texts are kept where a stage has nothing against them (the language stage rejects them),
repeated rows leave one, and an empty table passes. ``run`` writes each stage's result to the shared
folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.llm import jaccard_join, langid, packing, suffix_dedup, toxicity
from sedgework.llm.common import table, written


def apart(docs: DataFrame, *beside: str) -> DataFrame:
    """Some columns, and all others as one struct ``row``, so that new columns never clash with old ones."""
    others = [c for c in docs.columns if c not in beside]
    return docs.select(*beside, F.struct(*others, F.lit(None).cast("boolean").alias("__none")).alias("row"))


def together(rows: DataFrame, columns: list[str], **new) -> DataFrame:
    """The columns that ``apart`` has put apart, in their order; ``new`` ones take the place of old ones."""
    fields = rows.schema["row"].dataType.fieldNames()
    return rows.select(*[new.get(c, F.col(f"row.`{c}`") if c in fields else F.col(c)).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.Settings(), toxicity.learnable())
    return together(toxicity.score(apart(docs, "text"), model).where("predicted = 0"), docs.columns)


def drop_languageless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no text, no letter) go."""
    samples = langid.learn(docs, langid.Settings(), langid.learnable())
    return together(langid.predict(apart(docs, "text"), samples).where("lang_pred <> 'und'"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document of smaller doc_id has too are cut out of the text."""
    cut = suffix_dedup.remove_repeats(apart(docs, "doc_id", "text"), carry=("row",))
    return together(cut, docs.columns, text=F.col("kept"), n_chars=F.length("kept").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_languageless),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: Neither the learned stages nor the packing can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
