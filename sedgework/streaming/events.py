"""The event stream: counts by window, sessions, doubles, changes; each also works on a batch of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def late(events: DataFrame, wait: str) -> DataFrame:
    """A watermark for streams; batches need none."""
    return events.withWatermark("ts", wait) if events.isStreaming else events


def funnel(events: DataFrame, width: str = "1 day", wait: str = "1 hour") -> DataFrame:
    """Events and summed value of each type in each window of event time."""
    g = late(events, wait).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", wait: str = "1 hour") -> DataFrame:
    g = late(events, wait).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return g.select(F.col("w.start").alias("start"), "n", "users")


def settled(events: DataFrame, quiet: str = "30 minutes", wait: str = "1 hour") -> DataFrame:
    """The last event of each run of a user's events that a quiet period ends (a debounced write)."""
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    g = late(events, wait).groupBy(F.session_window("ts", quiet).alias("w"), "user_id").agg(F.count("*").alias("n"), last.alias("l"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("n"), F.col("l.event_id").alias("event_id"), F.col("l.event_type").alias("event_type"), F.col("l.value").alias("value"))


def once(events: DataFrame, keys: list[str], wait: str = "1 hour") -> DataFrame:
    """Events without doubles of a key; on a stream within the watermark."""
    if events.isStreaming:
        return late(events, wait).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def write_all(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; ``complete`` results replace the table at ``path``."""
    if mode == "append":
        return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return df.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def apply_changes(changes: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch of changes to ``merge(batch, id)``; the checkpoint is the cursor, so none is lost or taken twice if ``merge`` is idempotent in ``id``."""
    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
