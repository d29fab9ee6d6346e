"""A table of records: upserts, tombstones, change cursors, sweeps, validation, backups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, key: str, now: Column, touch: bool = True) -> DataFrame:
    """Rows of ``changes`` replace or join those of ``base`` (key unique in both).

    created_at of an existing row stays; updated_at becomes ``now`` unless ``touch`` is false. A column
    that ``changes`` lacks keeps its value. One full outer join; write the result to a new path.
    """
    b, c = base.alias("b"), changes.withColumn("__hit", F.lit(True)).alias("c")
    hit = F.col("c.__hit").isNotNull()
    cols = []
    for name in base.columns:
        if name == key:
            col = F.coalesce(f"b.{name}", f"c.{name}")
        elif name == "created_at":
            col = F.coalesce("b.created_at", *(["c.created_at"] if name in changes.columns else []), now)
        elif name == "updated_at":
            col = F.when(hit & F.lit(touch), now).otherwise(F.coalesce("b.updated_at", *(["c.updated_at"] if name in changes.columns else []), now))
        elif name in changes.columns:
            col = F.when(hit, F.col(f"c.{name}")).otherwise(F.col(f"b.{name}"))
        else:
            col = F.col(f"b.{name}")
        cols.append(col.cast(base.schema[name].dataType).alias(name))
    return b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full").select(*cols)


def live(df: DataFrame) -> DataFrame:
    return df.where("deleted_at is null")


def updated_since(df: DataFrame, since: Column) -> DataFrame:
    """Rows changed after the cursor, tombstones too."""
    return df.where(F.col("updated_at") > since)


def soft_delete(df: DataFrame, doomed: DataFrame, key: str, now: Column) -> DataFrame:
    """Mark the live rows that ``doomed`` names; their updated_at moves, so cursors see them."""
    hits = doomed.select(key).distinct().withColumn("__hit", F.lit(True))
    hit = F.col("__hit").isNotNull() & F.col("deleted_at").isNull()
    out = df.join(hits, key, "left")
    out = out.withColumns({"updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "deleted_at": F.when(hit, now).otherwise(F.col("deleted_at"))})
    return out.select(*df.columns)


def sweep(df: DataFrame, status: str, to: str, as_of: Column, days: int) -> DataFrame:
    """Rows of a status older than ``days`` get another status; rows without a time stay."""
    old = (F.col("status") == status) & (F.unix_timestamp(as_of) - F.unix_timestamp("created_at") > days * 86400)
    old = F.coalesce(old, F.lit(False))
    return df.withColumns({"swept": old, "status": F.when(old, to).otherwise(F.col("status"))})


def clear_dangling(df: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Null out a foreign key that no parent has, and flag it; nothing else changes."""
    known = parents.select(F.col(parent_key).alias("__k")).distinct().withColumn("__known", F.lit(True))
    out = df.join(known, F.col(column) == F.col("__k"), "left")
    gone = F.col("__known").isNull() & F.col(column).isNotNull()
    return out.withColumns({"dangling": gone, column: F.when(gone, None).otherwise(F.col(column))}).drop("__k", "__known")


def validated(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``reasons`` (names of broken rules, comma-joined in rule order) and ``ok``; an unknown outcome breaks a rule."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), None).otherwise(F.lit(name)) for name, rule in rules]))
    return df.withColumn("reasons", F.array_join(broken, ",")).withColumn("ok", F.col("reasons") == "")


def to_backup(df: DataFrame, store: str, binary: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text for each record, binary columns in base64."""
    cols = [F.base64(c).alias(c) if c in binary else F.col(c) for c in df.columns]
    return df.select(F.lit(store).alias("store"), F.to_json(F.struct(*cols)).alias("record"))


def from_backup(backup: DataFrame, schema: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """Parsed records with ``ok`` and ``reasons``; text that is no JSON object of the schema has the reason ``json``."""
    parsed = backup.withColumn("__r", F.from_json("record", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    rows = parsed.select("store", "__r.*", (F.col("__r").isNull() | F.col("__r._corrupt").isNotNull()).alias("__bad")).drop("_corrupt")
    return validated(rows, [("json", ~F.col("__bad")), *rules]).drop("__bad")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def children_of(children: DataFrame, parent: str, wanted: DataFrame, updated: str = "updated_at", deleted: str = "deleted_at") -> DataFrame:
    """The live children of some parents (one column, the parent's id), with ``nth``: newest first, ties by id."""
    from pyspark.sql import Window

    live = children.where(F.col(deleted).isNull()).join(wanted.distinct().toDF(parent), parent, "left_semi")
    return live.withColumn("nth", F.row_number().over(Window.partitionBy(parent).orderBy(F.desc(updated), "id")))


def delete_with_children(parents: DataFrame, children: DataFrame, parent: str, doomed: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Both tables with tombstones at ``now`` for some parents (column id) and all their live children."""
    gone = doomed.select("id").distinct().withColumn("__gone", F.lit(True))

    def marked(df: DataFrame, on: str) -> DataFrame:
        hit = F.col("__gone").isNotNull() & F.col("deleted_at").isNull()
        out = df.join(gone.withColumnRenamed("id", on), on, "left")
        return out.withColumns({c: F.when(hit, now).otherwise(F.col(c)) for c in ("deleted_at", "updated_at")}).select(*df.columns)

    return marked(parents, "id"), marked(children, parent)


def repointed(children: DataFrame, parent: str, merged: DataFrame) -> DataFrame:
    """Children of absorbed parents point to the survivor; their times stay. ``merged`` holds (absorbed, survivor)."""
    to = merged.select(F.col("absorbed").alias(parent), F.col("survivor").alias("__to")).dropDuplicates([parent])
    return children.join(to, parent, "left").withColumn(parent, F.coalesce("__to", parent)).select(*children.columns)
