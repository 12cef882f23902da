"""Windowed aggregates of the clickstream.

The same functions serve batch and streaming input; a stream passes a watermarked time column.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window, functions as F

from streamlake.session import run_dir

SESSION_GAP_MINUTES = 30


def tumble(clicks: DataFrame, time: str = "timestamp") -> DataFrame:
    """Events and total duration per user and minute. Counts and sums are combined before the
    one shuffle, so a busy user costs at most one row per minute and input partition."""
    return (clicks.groupBy("user_id", F.window(time, "1 minute").alias("w"))
            .agg(F.count("event_id").alias("event_count"),
                 F.sum("duration_ms").alias("total_duration_ms"))
            .select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "event_count", "total_duration_ms"))


def daily(minutes: DataFrame) -> DataFrame:
    """Daily totals of the minute aggregates."""
    return (minutes.groupBy(F.to_date("window_start").alias("day"))
            .agg(F.count("*").alias("user_minutes"), F.sum("event_count").alias("event_count"),
                 F.sum("total_duration_ms").alias("total_duration_ms")))


def _exists(spark, path: str) -> bool:
    """Whether a folder exists, asked of the file system Spark writes with."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def add_to_rollup(minutes: DataFrame, table: str, staging: str) -> list:
    """Fold a batch of minute aggregates into the roll-up below ``table``: ``minutes/`` (the minute
    aggregates, partitioned by day) and ``daily/`` (the daily totals, partitioned by day).

    Only the days the batch touches are written again, by dynamic partition overwrite: their stored
    minutes are read (the day filter prunes to their folders), summed with the batch's, staged in
    ``staging`` (a table is not overwritten while it is read) and written over those days' folders;
    their totals follow from the merged minutes. Other days keep their files. A minute that comes
    again, late, is summed with what is stored, so a user's minute is counted once. Returns the days.
    """
    spark = minutes.sparkSession
    batch = minutes.withColumn("day", F.to_date("window_start"))
    days = [r.day for r in batch.select("day").distinct().collect()]  # one row per day of the batch
    if not days:
        return []
    stored = (spark.read.parquet(f"{table}/minutes").where(F.col("day").isin(days))
              if _exists(spark, f"{table}/minutes") else None)
    merged = batch.select("day", "user_id", "window_start", "window_end", "event_count", "total_duration_ms")
    if stored is not None:
        merged = merged.unionByName(stored.select(*merged.columns))
    merged = (merged.groupBy("day", "user_id", "window_start", "window_end")
              .agg(F.sum("event_count").alias("event_count"),
                   F.sum("total_duration_ms").alias("total_duration_ms")))
    merged.write.parquet(staging)
    fresh = spark.read.parquet(staging)
    (fresh.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(f"{table}/minutes"))
    (daily(fresh).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(f"{table}/daily"))
    return days


def session_windows(clicks: DataFrame, time: str = "timestamp",
                    gap_minutes: int = SESSION_GAP_MINUTES) -> DataFrame:
    """Sessions by the built-in session window: the streaming form."""
    return (clicks.groupBy("user_id", F.session_window(time, f"{gap_minutes} minutes").alias("w"))
            .agg(F.count("event_id").alias("event_count"),
                 F.sum("duration_ms").alias("total_duration_ms"))
            .select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("session_end"),
                    "event_count", "total_duration_ms"))


def sessions(clicks: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES) -> DataFrame:
    """Sessions of stored events; equal to ``session_windows`` and safe for a dominant user.

    Two events of one user in the same gap-wide slot are always less than a gap apart, so each
    slot is first folded into one row, with a combine ahead of the shuffle. What is then ordered
    per user is bounded by the time span divided by the gap, whatever the number of events.
    """
    slots = (clicks.groupBy("user_id", F.window("timestamp", f"{gap_minutes} minutes").alias("w"))
             .agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
                  F.count("event_id").alias("event_count"),
                  F.sum("duration_ms").alias("total_duration_ms")))
    by_user = Window.partitionBy("user_id").orderBy("first_ts")
    gap = F.expr(f"INTERVAL {gap_minutes} MINUTES")
    starts = F.col("first_ts") > F.lag("last_ts").over(by_user) + gap
    return (slots.withColumn("starts", F.coalesce(starts, F.lit(True)).cast("int"))
            .withColumn("session_no", F.sum("starts").over(
                by_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .groupBy("user_id", "session_no")
            .agg(F.min("first_ts").alias("session_start"),
                 (F.max("last_ts") + gap).alias("session_end"),
                 F.sum("event_count").alias("event_count"),
                 F.sum("total_duration_ms").alias("total_duration_ms"))
            .drop("session_no"))


def join_orders(minutes: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders of customers with activity. The minutes are folded to one row per user first, so
    the join never multiplies a busy user's minutes with that customer's orders."""
    activity = (minutes.groupBy(F.col("user_id").alias("customer_id"))
                .agg(F.sum("event_count").alias("event_count"),
                     F.sum("total_duration_ms").alias("total_duration_ms"),
                     F.max("window_end").alias("last_seen")))
    return orders.join(activity, "customer_id").select(
        "order_id", "customer_id", "total_amount", "status",
        "event_count", "total_duration_ms", "last_seen")


ORDER_WINDOW = "1 hour"


def orders_after_clicks(clicks: DataFrame, placements: DataFrame, within: str = ORDER_WINDOW) -> DataFrame:
    """Each click with every order its user placed from the click on, up to ``within`` after it.

    An equi-join on the user with a time-range condition: in a batch Spark joins by user and checks the
    range; on two streams with watermarks the range also tells Spark when a row can no longer be
    matched, so the state of both sides is dropped as the watermarks pass.
    """
    c, p = clicks.alias("c"), placements.alias("p")
    condition = ((F.col("c.user_id") == F.col("p.user_id"))
                 & (F.col("p.placed_at") >= F.col("c.timestamp"))
                 & (F.col("p.placed_at") <= F.col("c.timestamp") + F.expr(f"INTERVAL {within}")))
    return c.join(p, condition).select(
        F.col("c.event_id").alias("event_id"), F.col("c.user_id").alias("user_id"),
        F.col("c.timestamp").alias("clicked_at"), F.col("p.order_id").alias("order_id"),
        F.col("p.placed_at").alias("placed_at"), F.col("p.total_amount").alias("total_amount"))


SLOTS = 1024  # time slots the events' span is cut into for the range join, a power of two


def with_state_at(events: DataFrame, history: DataFrame, event_key: str, state_key: str,
                  ts: str = "ts", slots: int = SLOTS) -> DataFrame:
    """Each event with every image of ``history`` of its key valid at its time
    (``valid_from <= ts < valid_to``, an open ``valid_to`` never ends).

    A range join through a binary tree over the events' time instead of a nested loop: the events' span
    is cut into ``slots`` equal slots (rounded up to a power of two), the leaves. An image's validity,
    clipped to the span, is listed as the few nodes that make it up: two of each level at most, the root
    alone if it covers the span. An event is looked up at its leaf and the nodes above it, on the levels
    that have images. So an event and an image meet at most once in the equi-join on key and node, and the
    exact condition decides. Events without key or time find nothing.

    The listed images are written below the shared folder first: the log is read and parsed once, and
    the levels that have images are known.
    """
    spark = history.sparkSession
    low, high = events.agg(F.min(ts), F.max(ts)).first()
    if low is None:  # no event has a time: none finds a state
        low = high = datetime.datetime(1970, 1, 1)
    start = F.lit(low).cast("timestamp_ntz")
    levels = (slots - 1).bit_length()
    slots = 1 << levels
    width = max((high - low).total_seconds() * 1_000_000 / slots, 1.0)

    def slot(t):
        micros = F.unix_micros(t.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
        return F.least(F.floor(micros / F.lit(width)).cast("long"), F.lit(slots - 1).cast("long"))

    def node(level, place):  # numbered from the root, 1, so that a node's parent is half its number
        return F.lit(1 << (levels - level)).cast("long") + place

    # A run of nodes of a level gives away its first if odd and its last if even; their parents make up the rest.
    ends = []
    for level in range(levels + 1):
        begin = F.shiftright(F.col("_begin") + ((1 << level) - 1), level)
        end = F.shiftright(F.col("_end"), level)
        ends += [F.when((begin < end) & (begin % 2 == 1), node(level, begin)),
                 F.when((begin < end) & (end % 2 == 1), node(level, end - 1))]

    first = F.greatest(F.col("valid_from"), start)
    last = F.least(F.coalesce(F.col("valid_to"), F.lit(high).cast("timestamp_ntz")),
                   F.lit(high).cast("timestamp_ntz"))
    listed = (history.where(F.coalesce(F.col("valid_to") > start, F.lit(True))
                            & (F.col("valid_from") <= F.lit(high).cast("timestamp_ntz")))
              .withColumns({"_begin": slot(first), "_end": slot(last) + 1})
              .withColumn("_node", F.explode(F.array_compact(F.array(*ends)))).drop("_begin", "_end"))
    path = run_dir(spark, "states-listed")
    listed.write.parquet(path)
    listed = spark.read.schema(listed.schema).parquet(path)
    level_of = F.lit(levels + 1) - F.length(F.bin("_node"))
    used = sorted(r[0] for r in listed.select(level_of).distinct().collect())  # `levels + 1` at most
    if not used:
        used = [0]
    above = F.array(*[F.shiftright(F.col("_leaf"), level) for level in used])
    placed = (events.withColumn("_leaf", node(0, slot(F.col(ts))))
              .withColumn("_node", F.explode(above)).drop("_leaf"))
    found = placed.join(listed, (F.col(event_key) == F.col(state_key)) & (placed["_node"] == listed["_node"])
                        & (F.col("valid_from") <= F.col(ts))
                        & F.coalesce(F.col(ts) < F.col("valid_to"), F.lit(True)))
    return found.drop("_node")
