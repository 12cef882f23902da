"""Validity intervals from a change log, and the range join of events with them through time slots."""

import datetime
import random

from pyspark.sql import functions as F

from streamlake.operators import cdc, clickstream

BASE = datetime.datetime(2024, 1, 1)


def test_history_closes_each_image_at_the_next_change(spark):
    rows = [(1, "a", "r", 0, 0), (1, "b", "u", 1000, 1), (1, "b", "d", 5000, 2), (2, "c", "r", 0, 0)]
    changes = spark.createDataFrame(rows, "id long, v string, op string, ts_ms long, seq long")
    got = sorted((r.id, r.v, r.valid_from, r.valid_to) for r in cdc.history(changes, "id").collect())
    at = lambda ms: BASE.replace(year=1970) + datetime.timedelta(milliseconds=ms)
    assert got == [(1, "a", at(0), at(1000)), (1, "b", at(1000), at(5000)), (2, "c", at(0), None)]


def test_slot_join_equals_brute_force(spark):
    rng = random.Random(2)
    events = [(i, rng.choice([1, 1, 1, 2, 3, None]), None if i % 50 == 0 else BASE + datetime.timedelta(minutes=rng.randrange(600)))
              for i in range(400)]
    states = []
    for key in (1, 2, 3, None):
        t = BASE - datetime.timedelta(minutes=100)
        for n in range(8):
            end = t + datetime.timedelta(minutes=rng.randrange(1, 200))
            states.append((key, f"s{n}", t, None if n == 7 else end))
            t = end
    ev = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz")
    st = spark.createDataFrame(states, "customer_id long, status string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    for slots in (1, 7, 1024):
        joined = clickstream.with_state_at(ev, st, "user_id", "customer_id", slots=slots)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
        got = sorted((r.event_id, r.status) for r in joined.collect())
        want = sorted((e, s) for e, u, t in events for k, s, a, b in states
                      if u is not None and t is not None and k == u and a <= t and (b is None or t < b))
        assert got == want
    none = ev.where(F.col("ts").isNull())
    assert clickstream.with_state_at(none, st, "user_id", "customer_id").count() == 0


def test_an_image_is_listed_in_few_nodes_of_the_time_tree(spark, tmp_path, monkeypatch):
    # Images open over the whole span were listed once in each of its slots.
    monkeypatch.setattr(clickstream, "run_dir", lambda spark, job: str(tmp_path / job), raising=False)
    rng = random.Random(5)
    minute = lambda m: BASE + datetime.timedelta(minutes=m)
    events = [(i, rng.randrange(3), minute(rng.randrange(1000))) for i in range(300)]
    events += [(300, 1, minute(0)), (301, 1, minute(999)), (301, 1, minute(999)), (302, 1, None), (303, None, minute(5))]
    states = [(k, f"whole{k}", minute(-10), None) for k in (0, 1, 1, 2)]
    states += [(1, "from start", minute(0), None), (1, "to the end", minute(-5), minute(999)), (1, "past", minute(-9), minute(0)),
               (1, "later", minute(1000), None), (1, "at the end", minute(999), None), (1, "backwards", minute(700), minute(300)),
               (1, "empty", minute(50), minute(50)), (1, "no begin", None, None), (None, "no key", minute(-1), None)]
    states += [(rng.randrange(3), f"part{i}", minute(a := rng.randrange(990)), minute(a + rng.randrange(1, 990))) for i in range(40)]
    ev = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz")
    st = spark.createDataFrame(states, "customer_id long, status string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    joined = clickstream.with_state_at(ev, st, "user_id", "customer_id", slots=1024)
    assert joined.columns == ev.columns + st.columns
    got = sorted((r.event_id, r.status) for r in joined.collect())
    assert got == sorted((e, s) for e, u, t in events for k, s, a, b in states
                         if u is not None and t is not None and a is not None and k == u and a <= t and (b is None or t < b))
    times = dict(spark.read.parquet(str(tmp_path / "states-listed")).groupBy("status").count().collect())
    assert all(times[s] == (2 if s == "whole1" else 1) for s in times if s.startswith("whole"))
    assert times["from start"] == times["to the end"] == 1 and max(times.values()) <= 2 * 10
