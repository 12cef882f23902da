"""Chart queries. Row limits are part of the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EVENTS_ROW_LIMIT = 10000
ORDERS_ROW_LIMIT = 100


def events_per_minute(minutes: DataFrame, where: Column | None = None,
                      row_limit: int = EVENTS_ROW_LIMIT) -> DataFrame:
    """Line chart: events per minute over all users, the busiest minutes within the limit."""
    rows = minutes if where is None else minutes.where(where)
    return (rows.groupBy("window_start").agg(F.sum("event_count").alias("event_count"))
            .orderBy(F.desc("event_count"), "window_start").limit(row_limit)
            .orderBy("window_start"))


def orders_by_status(orders: DataFrame, where: Column | None = None,
                     row_limit: int = ORDERS_ROW_LIMIT) -> DataFrame:
    """Bar chart: orders per status, the largest within the limit."""
    rows = orders if where is None else orders.where(where)
    return (rows.groupBy("status").agg(F.count("order_id").alias("order_count"))
            .orderBy(F.desc("order_count"), "status").limit(row_limit).orderBy("status"))


def orders_by_status_series(orders: DataFrame) -> DataFrame:
    """The same chart with one series per status, in long form, so no status is left out."""
    return orders_by_status(orders).select("status", F.col("status").alias("series"), "order_count")


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("row_count"))
