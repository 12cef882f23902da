"""Audit: one timeline over decisions, table changes and query history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def decision_log(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        F.lit("decision").alias("source"), F.col("ts"),
        F.col("context.identity.user").alias("principal"),
        F.col("action.operation").alias("action"),
        F.when(F.col("allowed"), "allowed").otherwise("denied").alias("outcome"))


def change_log(changes: DataFrame, table: str, key: str) -> DataFrame:
    return changes.select(
        F.lit("database").alias("source"),
        F.timestamp_millis("ts_ms").cast("timestamp_ntz").alias("ts"),
        F.col("op").alias("action"),
        F.concat(F.lit(f"{table}/"), F.col(key)).alias("target"))


def query_log(queries: DataFrame) -> DataFrame:
    return queries.select(
        F.lit("query").alias("source"), F.col("timestamp").alias("ts"),
        F.concat(F.lit("user_"), "user_id").alias("principal"),
        F.col("action"), F.concat(F.lit("query/"), "event_id").alias("target"))


def timeline(*logs: DataFrame) -> DataFrame:
    """Union of the logs in time order; columns a log lacks are null."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)
    return union.orderBy("ts", "source", "principal", "target", "action")


def recent_denials(decisions: DataFrame, days: int = 1) -> DataFrame:
    """Denied requests per operation in the last days of the log."""
    newest = decisions.agg(F.max("ts").alias("newest"))
    recent = decisions.sparkSession.sql(
        "SELECT * FROM {decisions} WHERE NOT allowed AND ts > "
        "(SELECT newest FROM {newest}) - make_interval(0, 0, 0, {days})",
        decisions=decisions, newest=newest, days=days)
    return (recent.groupBy(F.col("action.operation").alias("operation"))
            .agg(F.count("*").alias("denials")))
