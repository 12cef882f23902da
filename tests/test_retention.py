"""Superseded files go after the retention time; files in use and young files stay."""

import datetime
import os

from streamlake.operators import maintenance
from streamlake.session import run_dir, shared_dir
from streamlake.sources.tables import load


def parquet_files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_expire_superseded_files(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    source, merged = run_dir(spark, "fragments"), run_dir(spark, "compaction")
    orders.repartition(16).write.partitionBy("o_orderstatus").parquet(source)
    plan = maintenance.compact(spark, source, merged, small_bytes=10_000_000, target_bytes=20_000)
    planned = {r.path.removeprefix("file:") for r in plan.select("path").collect()}
    before = parquet_files(source)
    assert planned and planned <= before
    in_use = parquet_files(merged)
    now = datetime.datetime.now()
    assert maintenance.expire_superseded(spark, source, plan, now).count() == 0  # all still young
    gone = maintenance.expire_superseded(spark, source, plan, now + datetime.timedelta(days=8))
    assert {r.path.removeprefix("file:") for r in gone.collect()} == planned
    assert parquet_files(source) == before - planned
    assert parquet_files(merged) == in_use and in_use
    table = maintenance.compacted(spark, source, merged, plan).select(*orders.columns)
    assert sorted(table.collect()) == sorted(orders.collect())


def test_clear_runs_removes_old_job_folders(spark, tmp_path):
    root = str(tmp_path / "streamlake")  # a folder of its own: other tests' runs are not touched
    folder = f"{root}/old-job-1"
    spark.range(3).write.parquet(folder)
    assert maintenance.clear_runs(spark, datetime.datetime.now(), root=root) == []
    gone = maintenance.clear_runs(spark, datetime.datetime.now() + datetime.timedelta(days=8), root=root)
    assert [g.rsplit("/", 1)[-1] for g in gone] == ["old-job-1"]
    assert not os.path.exists(folder) and os.path.exists(shared_dir(spark))
