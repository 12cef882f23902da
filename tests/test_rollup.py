"""Incremental daily roll-up: only the days a batch touches are written again."""

import os

from pyspark.sql import functions as F

from streamlake.operators import clickstream
from streamlake.sources import derive
from streamlake.sources.tables import load


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.path.getmtime(os.path.join(d, f))
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_untouched_days_keep_their_files(spark, sf_dir, tmp_path):
    events = load(spark, sf_dir, "events")
    table = str(tmp_path / "rollup")
    days = sorted(r.d for r in events.select(F.to_date("ts").alias("d")).distinct().collect())
    late_day = days[len(days) // 2]
    on_time = events.where(~((F.to_date("ts") == F.lit(late_day)) & (F.col("event_id") % 3 == 0)))
    late = events.where((F.to_date("ts") == F.lit(late_day)) & (F.col("event_id") % 3 == 0))
    clickstream.add_to_rollup(clickstream.tumble(derive.clickstream(on_time)), table, str(tmp_path / "s0"))
    before = files(f"{table}/daily")
    touched = clickstream.add_to_rollup(clickstream.tumble(derive.clickstream(late)), table, str(tmp_path / "s1"))
    after = files(f"{table}/daily")
    assert touched == [late_day]
    mark = f"day={late_day}"
    assert {k: v for k, v in before.items() if mark not in k} == {k: v for k, v in after.items() if mark not in k}
    assert {k for k in before if mark in k} != {k for k in after if mark in k}
    got = sorted(spark.read.parquet(f"{table}/daily").select("day", "user_minutes", "event_count", "total_duration_ms").collect())
    want = sorted(clickstream.daily(clickstream.tumble(derive.clickstream(events))).collect())
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
