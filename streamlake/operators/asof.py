"""As-of join: each row of a log with the newest row of another log of its key at or before its time.

Both logs are put into one, ordered by key and time, and the newest value of the second log is carried
along by a window. Nothing is compared pairwise, so there is no range join. A key with many rows would
be one window partition, sorted in one task; so every key is cut into time ranges of about
``range_rows`` rows (equal widths of its own time span), each range a window partition of its own. What
a range starts with is the newest value of the ranges before it: one row per range and key, carried by a
small window, joined back by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGE_ROWS = 2_000_000  # rows of one key sorted together, about


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def last_before(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
                order: str, name: str = "in_force", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``left`` with a struct column ``name``: the ``right`` row (all its columns) of the same ``key``
    with the latest ``right_ts`` at or before ``left_ts``, ties of time broken by the larger ``order``.

    A change at the very time of a left row is in force for it. Left rows whose key or time is null,
    or without such a right row, get null. Right rows with a null key or time are never in force.
    Repeated left rows each keep their own row.
    """
    whole_left = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    whole_right = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    left_type = left.select(whole_left.alias("v")).schema[0].dataType
    right_type = right.select(whole_right.alias("v")).schema[0].dataType
    lefts = left.select(F.col(key).alias("_key"), _micros(F.col(left_ts)).alias("_t"),
                        F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_order"),
                        whole_left.alias("_row"), F.lit(None).cast(right_type).alias("_value"))
    rights = (right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull())
              .select(F.col(key).alias("_key"), _micros(F.col(right_ts)).alias("_t"), F.lit(0).alias("_kind"),
                      F.col(order).cast("long").alias("_order"), F.lit(None).cast(left_type).alias("_row"),
                      whole_right.alias("_value")))
    rows = lefts.unionByName(rights)
    timed = rows.where(F.col("_key").isNotNull() & F.col("_t").isNotNull())

    spans = timed.groupBy("_key").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"),
                                      F.count("*").alias("_rows"))
    ranges = F.ceil(F.col("_rows") / range_rows)
    place = F.floor((F.col("_t") - F.col("_low")).cast("double") * ranges
                    / (F.col("_high") - F.col("_low") + 1).cast("double")).cast("long")
    placed = timed.join(spans, "_key").withColumn("_range", place).drop("_low", "_high", "_rows")

    newest = F.max_by("_value", F.struct(F.col("_t"), F.col("_order")))
    per_range = (placed.where(F.col("_kind") == 0).groupBy("_key", "_range").agg(newest.alias("_last")))
    wanted = placed.where(F.col("_kind") == 1).select("_key", "_range").distinct()
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (wanted.join(per_range, ["_key", "_range"], "full")
              .withColumn("_start", F.last("_last", ignorenulls=True).over(before))
              .select("_key", "_range", "_start"))

    within = (Window.partitionBy("_key", "_range").orderBy("_t", "_kind", "_order")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried_along = placed.withColumn("_seen", F.last("_value", ignorenulls=True).over(within))
    found = (carried_along.where(F.col("_kind") == 1).join(starts, ["_key", "_range"], "left")
             .select("_row", F.coalesce("_seen", "_start").alias(name)))
    untimed = rows.where((F.col("_kind") == 1) & (F.col("_key").isNull() | F.col("_t").isNull())) \
        .select("_row", F.col("_value").alias(name))
    return found.unionByName(untimed).select("_row.*", name)
