"""Streams of observations into the store: late rows are revisions, so no watermark is needed for correctness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store


def daily(events: DataFrame) -> DataFrame:
    """Number and total value of each event type and day of events (ts, event_type, value)."""
    day = F.window("ts", "1 day")
    return events.groupBy(day, "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("window.start").cast("date").alias("date"), "event_type", "n", "total")


def daily_stream(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """daily() over a stream; the watermark only bounds state, and days older than the delay are final."""
    return daily(events.withWatermark("ts", delay))


def refresh(stream: DataFrame, store: Store, metadata: list[dict], checkpoint: str, clock=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) -> StreamingQuery:
    """Upserts each micro-batch of (series_id, date, value). Stops when the source has no more for now.

    The store notes the last batch of each checkpoint, so a batch that runs again changes nothing,
    its log of imports included. Equal rows of a batch count once; a date with two values in one
    batch fails it, as nothing tells which is right.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            rows = batch.groupBy("series_id", "date").agg(F.max("value").alias("value"), (F.min("value") != F.max("value")).alias("_two"))
            two = rows.agg(F.count_if("_two")).first()[0]
            if two:
                raise ValueError(f"{two} dates have two values in one batch")
            named = {r["series_id"] for r in rows.select("series_id").distinct().limit(len(metadata) + 1).collect()}  # one more than metadata has is one too many
            store.upsert([m for m in metadata if m["series_id"] in named], rows.drop("_two"), clock(), stream=(checkpoint, number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
