from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from streamlake.operators import clickstream, dashboards

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id STRING, user_id STRING, timestamp TIMESTAMP_NTZ, duration_ms INT"


def clicks(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_tumble_ignores_nulls_and_aligns_to_the_minute(spark):
    df = clickstream.tumble(clicks(spark, [
        ("a", "u", T0 + timedelta(seconds=59, milliseconds=999), 10),
        (None, "u", T0 + timedelta(seconds=1), 5),
        ("b", "u", T0 + timedelta(seconds=60), None)]))
    assert rows_of(df, "window_start", "window_end", "event_count", "total_duration_ms") == [
        (T0, T0 + timedelta(minutes=1), 1, 15),
        (T0 + timedelta(minutes=1), T0 + timedelta(minutes=2), 1, None)]
    assert dict(df.dtypes)["total_duration_ms"] == "bigint"


def test_sessions_split_only_beyond_the_gap(spark):
    gap = timedelta(minutes=30)
    df = clickstream.sessions(clicks(spark, [
        ("a", "u", T0 + timedelta(minutes=7), 1), ("b", "u", T0 + timedelta(minutes=7) + gap, 1),
        ("c", "u", T0 + timedelta(minutes=7, microseconds=1) + 2 * gap, 1)]))
    assert rows_of(df, "event_count") == [(1,), (2,)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60 * 12)), min_size=1, max_size=60))
def test_sessions_equal_the_builtin_session_window(spark, events):
    df = clicks(spark, [(f"e{i}", f"u{u}", T0 + timedelta(minutes=m), i)
                        for i, (u, m) in enumerate(events)])
    columns = ("user_id", "session_start", "session_end", "event_count", "total_duration_ms")
    assert (rows_of(clickstream.sessions(df), *columns)
            == rows_of(clickstream.session_windows(df), *columns))


def test_order_join_keeps_one_row_per_order_of_a_busy_user(spark):
    minutes = clickstream.tumble(clicks(spark, [
        (f"e{i}", "1", T0 + timedelta(minutes=i), 2) for i in range(500)]))
    minutes = minutes.withColumn("user_id", F.col("user_id").cast("bigint"))
    orders = spark.range(300).select(
        F.col("id").alias("order_id"), F.lit(1).cast("bigint").alias("customer_id"),
        F.lit(1).cast("decimal(10,2)").alias("total_amount"), F.lit("O").alias("status"))
    joined = clickstream.join_orders(minutes, orders)
    assert joined.count() == 300
    assert joined.first()["event_count"] == 500


def test_chart_limit_keeps_the_busiest_minutes_in_time_order(spark):
    minutes = spark.createDataFrame(
        [(T0 + timedelta(minutes=i), n) for i, n in enumerate([3, 9, 1, 7])],
        "window_start TIMESTAMP_NTZ, event_count BIGINT")
    top = dashboards.events_per_minute(minutes, row_limit=2).collect()
    assert [(r.window_start.minute, r.event_count) for r in top] == [(1, 9), (3, 7)]
    assert dashboards.events_per_minute(minutes, F.col("event_count") < 5).count() == 2


@pytest.mark.parametrize("name", ["tumble", "sessions"])
def test_aggregation_is_combined_ahead_of_the_shuffle(spark, name):
    plan = getattr(clickstream, name)(clicks(spark, [("a", "u", T0, 1)]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    first_shuffle = text.rindex("Exchange hashpartitioning")
    assert "partial_count" in text[first_shuffle:]
