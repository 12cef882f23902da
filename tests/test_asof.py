"""As-of join against brute force: hot keys cut into time ranges, ties, nulls, repeated rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from streamlake.operators import asof

BASE = datetime.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else BASE + datetime.timedelta(seconds=seconds)


def brute(lefts, rights):
    out = []
    for lid, key, t in lefts:
        best = None
        for version, rkey, rt, value in rights:
            if key is None or t is None or rkey != key or rt is None or rt > t:
                continue
            if best is None or (rt, version) > (best[2], best[0]):
                best = (version, rkey, rt, value)
        out.append((lid, None if best is None else best[0]))
    return sorted(out, key=repr)


def run(spark, lefts, rights, range_rows):
    left = spark.createDataFrame([(i, k, at(t)) for i, k, t in lefts], "id long, key string, ts timestamp")
    right = spark.createDataFrame([(v, k, at(t), val) for v, k, t, val in rights],
                                  "version long, key string, ts timestamp, value string")
    joined = asof.last_before(left, right, "key", "ts", "ts", "version", "policy", range_rows)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    return sorted(((r.id, r.policy.version if r.policy else None) for r in joined.collect()), key=repr)


@pytest.mark.parametrize("range_rows", [1_000_000, 7])
def test_equals_brute_force_with_a_hot_key(spark, range_rows):
    rng = random.Random(5)
    # a third of all rows on key "hot"; times repeat, so ties of time occur on both sides
    keys = ["hot"] * 100 + ["a", "b", "c", None] * 50
    lefts = [(i, rng.choice(keys), rng.choice([None] + list(range(60)))) for i in range(300)]
    lefts += lefts[:10]  # repeated rows keep their own rows
    rights = [(v, rng.choice(keys), rng.choice([None] + list(range(60))), f"v{v}") for v in range(120)]
    assert run(spark, lefts, rights, range_rows) == brute(lefts, rights)


def test_change_at_the_same_time_is_in_force_and_larger_order_wins(spark):
    lefts = [(1, "t", 10), (2, "t", 9), (3, "u", 10)]
    rights = [(5, "t", 10, "x"), (7, "t", 10, "y"), (6, "t", 3, "z")]
    assert run(spark, lefts, rights, 1) == [(1, 7), (2, 6), (3, None)]


def test_empty_sides(spark):
    assert run(spark, [(1, "t", 1)], [], 5) == [(1, None)]
    assert run(spark, [], [(1, "t", 1, "x")], 5) == []


def test_hot_key_is_cut_into_ranges(spark):
    left = spark.range(3000).select(F.col("id"), F.lit("hot").alias("key"),
                                    F.timestamp_seconds(F.col("id")).alias("ts"))
    right = spark.range(0, 3000, 100).select(F.col("id").alias("version"), F.lit("hot").alias("key"),
                                            F.timestamp_seconds(F.col("id") + 1).alias("ts"))
    joined = asof.last_before(left, right, "key", "ts", "ts", "version", "policy", range_rows=500)
    got = {r.id: r.version for r in joined.select("id", "policy.version").collect()}
    assert all(got[i] == (None if i < 1 else ((i - 1) // 100) * 100) for i in range(3000))
    # the carrying window is partitioned by key and time range, so the one key spreads over tasks
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key#" in plan and ", _range#" in plan and "NestedLoopJoin" not in plan
