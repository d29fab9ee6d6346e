"""Readers of the driver's tables and of the records that queries make of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys over as many tasks as shuffles have: a table of small rows is one part of a file, whatever is computed of each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def stream(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """The files of a table as a stream; times without a zone count as the session's, as watermarks need."""
    schema = table(spark, sf_dir, name).schema
    rows = spark.readStream.schema(schema).options(**options).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"})


def as_view(df: DataFrame) -> str:
    """A name for a table in SQL text; each call gives another, so that queries on different folders don't meet."""
    name = f"sedgework_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name
