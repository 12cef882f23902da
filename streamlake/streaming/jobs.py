"""Continuous jobs. Each starts one streaming query with its own checkpoint and returns it.

A ``processingTime`` trigger of 30 seconds is the deployed commit interval; ``availableNow``
works off what is there and stops. The output is exactly-once: files become visible when their
batch commits, and a restart from the same checkpoint repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from streamlake.operators import cdc, clickstream
from streamlake.sources.topics import (CLICK_SCHEMA, CUSTOMER_ROW, ORDER_ROW, decode,
                                       envelope_schema)

WATERMARK_DELAY = "5 seconds"
COMMIT_INTERVAL = {"processingTime": "30 seconds"}
DRAIN = {"availableNow": True}


def watermarked(records: DataFrame) -> DataFrame:
    """Decoded clickstream with its event-time watermark. Watermarks need a zoned timestamp, so
    the zone-less event time is read as UTC; the window bounds drop the zone again."""
    return (decode(records, CLICK_SCHEMA)
            .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
            .withWatermark("timestamp", WATERMARK_DELAY))


def _append(rows: DataFrame, path: str, checkpoint: str, trigger: dict, name: str) -> StreamingQuery:
    return (rows.writeStream.queryName(name).format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def run_tumble(records: DataFrame, path: str, checkpoint: str,
               trigger: dict = COMMIT_INTERVAL) -> StreamingQuery:
    """Minute aggregates, each written once, when the watermark passes the window's end."""
    return _append(clickstream.tumble(watermarked(records)), path, checkpoint, trigger,
                   "clickstream_tumble")


def run_sessions(records: DataFrame, path: str, checkpoint: str,
                 trigger: dict = COMMIT_INTERVAL) -> StreamingQuery:
    return _append(clickstream.session_windows(watermarked(records)), path, checkpoint, trigger,
                   "clickstream_sessions")


def run_orders_after_clicks(records: DataFrame, placements: DataFrame, path: str, checkpoint: str,
                            trigger: dict = COMMIT_INTERVAL) -> StreamingQuery:
    """Stream-stream interval join of clicks and order placements, both with watermarks: a match is
    written once, in the batch that finds it; rows leave the state once no later row can match them."""
    orders = (placements.withColumn("placed_at", F.col("placed_at").cast("timestamp"))
              .withWatermark("placed_at", WATERMARK_DELAY))
    joined = clickstream.orders_after_clicks(watermarked(records), orders)
    return _append(joined.withColumns({"clicked_at": F.col("clicked_at").cast("timestamp_ntz"),
                                       "placed_at": F.col("placed_at").cast("timestamp_ntz")}),
                   path, checkpoint, trigger, "orders_after_clicks")


def _changes(records: DataFrame, row: str, typed) -> DataFrame:
    return typed(cdc.normalize(decode(records, envelope_schema(row))))


def run_orders_upsert(records: DataFrame, path: str, checkpoint: str,
                      trigger: dict = COMMIT_INTERVAL) -> StreamingQuery:
    """Orders mirror: the typed changes are appended by the file sink, which makes the files of a
    batch visible when it commits and a repeated batch only once. A batch costs what its changes
    cost. ``current_image`` takes the last image on read, ``fold`` writes it as a base."""
    return _append(_changes(records, ORDER_ROW, cdc.mirror_orders), path, checkpoint, trigger,
                   "orders_upsert")


def run_customers_upsert(records: DataFrame, path: str, checkpoint: str,
                         trigger: dict = COMMIT_INTERVAL) -> StreamingQuery:
    return _append(_changes(records, CUSTOMER_ROW, cdc.mirror_customers), path, checkpoint, trigger,
                   "customers_upsert")


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped so far because their window had closed."""
    return sum(state["numRowsDroppedByWatermark"]
               for progress in query.recentProgress for state in progress["stateOperators"])


def current_image(spark: SparkSession, path: str, key: str, base: str | None = None) -> DataFrame:
    """Mirror table: the last image of every key in the changes at ``path``, and in the base for keys
    that did not change since it was written."""
    changes = spark.read.parquet(path)
    if base is None:
        return cdc.current_rows(changes, key)
    folded = spark.read.parquet(base)
    upto = folded.agg(F.max("seq")).first()[0]
    since = changes if upto is None else changes.where(F.col("seq") > upto)
    return cdc.merge(folded, since, key)


def fold(spark: SparkSession, path: str, key: str, new_base: str, upto: int) -> None:
    """Write the image of the changes up to position ``upto`` as a base."""
    changes = spark.read.parquet(path).where(F.col("seq") <= upto)
    cdc.current_rows(changes, key).withColumn("seq", F.lit(upto).cast("bigint")).write.parquet(new_base)
