from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamlake.operators import audit, dashboards, loading, maintenance
from streamlake.session import run_dir, shared_dir
from streamlake.sources.tables import ensure_table, register_views, rest_catalog_conf

MB = 1024 * 1024


def files(folder):
    return [p for p in folder.iterdir() if p.suffix == ".parquet"]


# --- loading -------------------------------------------------------------------------------

CUSTOMERS = "name STRING, email STRING, city STRING"


def test_insert_ignore_keeps_existing_and_first_new_rows(spark):
    target = spark.createDataFrame([("Old", "a@x", "s")], CUSTOMERS)
    incoming = spark.createDataFrame(
        [(1, "New", "a@x", "s"), (3, "Second", "b@x", "s"), (2, "First", "b@x", "s")], "pos INT, " + CUSTOMERS)
    once = loading.insert_ignore(target, incoming, "email", "pos")
    assert sorted(r.name for r in once.collect()) == ["First", "Old"]
    again = loading.insert_ignore(once, incoming, "email", "pos")
    assert again.count() == 2


def test_seed_enters_an_empty_table_once(spark):
    empty = spark.createDataFrame([], "customer_id INT, total_amount DECIMAL(10,2), status STRING")
    once = loading.insert_if_empty(empty, loading.seed(spark, loading.SEED_ORDERS))
    assert once.count() == 4
    assert loading.insert_if_empty(once, loading.seed(spark, loading.SEED_ORDERS)).count() == 4
    assert loading.seed(spark, loading.SEED_CUSTOMERS).columns == ["name", "email", "city"]


def test_null_references_are_no_violations(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id INT, ref INT")
    parent = spark.createDataFrame([(1,)], "pk INT")
    assert [r.id for r in loading.fk_violations(child, parent, "ref", "pk").collect()] == [2]


def test_constraints(spark):
    rows = spark.createDataFrame([(1, "a", "xy"), (2, "a", None), (3, None, "long"), (4, None, "")],
                                 "id INT, email STRING, city STRING")
    assert [tuple(r) for r in loading.unique_violations(rows, "email").collect()] == [("a", 2)]
    assert loading.unique_violations(rows, "email", "city").count() == 0
    nulls = loading.not_null_violations(rows, "id", "email", "city").collect()
    assert sorted(tuple(r) for r in nulls) == [(2, "city"), (3, "email"), (4, "email")]
    assert [tuple(r) for r in loading.length_violations(rows, "id", city=3).collect()] == [(3, "city", 4)]


# --- namespaces ----------------------------------------------------------------------------

def test_creation_leaves_existing_tables_alone(spark):
    for _ in range(2):
        ensure_table(spark, "lake_test", "orders", "order_id INT, status STRING",
                     properties={"team": "tests"})
        spark.sql("INSERT INTO lake_test.orders VALUES (1, 'O')")
    assert spark.table("lake_test.orders").count() == 2
    assert dashboards.row_count(spark.table("lake_test.orders")).first().row_count == 2
    spark.sql("DROP DATABASE lake_test CASCADE")


def test_load_time_defaults_to_now(spark):
    ensure_table(spark, "lake_test2", "customers",
                 "name STRING NOT NULL, created_at TIMESTAMP DEFAULT current_timestamp()")
    spark.sql("INSERT INTO lake_test2.customers (name) VALUES ('Alice Kim')")
    age = spark.sql("SELECT timestampdiff(MINUTE, created_at, current_timestamp()) AS m FROM lake_test2.customers")
    assert age.first().m == 0
    spark.sql("DROP DATABASE lake_test2 CASCADE")


def test_views_and_catalog_settings(spark, sf_dir):
    register_views(spark, sf_dir, ["nation"])
    assert spark.sql("SELECT COUNT(*) AS n FROM nation").first().n == 25
    conf = rest_catalog_conf("iceberg", "http://catalog/", "lake", "http://store")
    assert conf["spark.sql.catalog.iceberg.type"] == "rest"
    assert conf["spark.sql.catalog.iceberg.s3.path-style-access"] == "true"


def test_jobs_write_below_the_configured_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == root
    assert run_dir(spark, "a").startswith(root + "/") and run_dir(spark, "a") != run_dir(spark, "a")


# --- maintenance ---------------------------------------------------------------------------

def partitioned(spark, folder, files_each=20):
    rows = spark.range(4000).select("id", F.rand(1).alias("v"), (F.col("id") % 3).cast("string").alias("kind"))
    rows.repartition(files_each).write.partitionBy("kind").parquet(str(folder))
    return spark.read.parquet(str(folder))


def parquet_files(folder):
    return sorted(folder.rglob("*.parquet"))


def same(a, b):
    b = b.select(*a.columns)
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_small_files_are_merged_within_their_partition(spark, tmp_path):
    source, out = tmp_path / "small", tmp_path / "big"
    rows = partitioned(spark, source)
    before = {p: p.stat().st_mtime_ns for p in parquet_files(source)}
    plan = maintenance.compact(spark, str(source), str(out))
    assert plan.count() == 60 and len(parquet_files(out)) == 3
    assert sorted(p.name for p in out.iterdir() if p.is_dir()) == ["kind=0", "kind=1", "kind=2"]
    assert same(rows, maintenance.compacted(spark, str(source), str(out), plan))
    assert {p: p.stat().st_mtime_ns for p in parquet_files(source)} == before


def test_folders_and_paths_of_any_spelling_are_merged_whole(spark, tmp_path):
    source, out = tmp_path / "a table 100%25 é", tmp_path / "big ones"
    values = ["plain", "New York", "é", "a:b", "50%", "2024-01-01 10:00:00", None]
    rows = spark.createDataFrame([(i, v) for v in values for i in range(40)], "id long, c string")
    rows.repartition(4).write.partitionBy("c").parquet(str(source))
    plan = maintenance.compact(spark, str(source), str(out))
    assert plan.count() == len(parquet_files(source)) > len(parquet_files(out)) == len(values)
    assert same(rows, maintenance.compacted(spark, str(source), str(out), plan))


def test_large_and_lone_files_are_left_alone(spark, tmp_path):
    source, out = tmp_path / "mixed", tmp_path / "merged"
    rows = spark.range(60000).withColumn("v", F.rand(1))
    rows.where("id >= 600").coalesce(1).write.parquet(str(source))
    rows.where("id < 600").repartition(6).write.mode("append").parquet(str(source))
    limit = max(p.stat().st_size for p in parquet_files(source))
    plan = maintenance.compact(spark, str(source), str(out), small_bytes=limit)
    assert plan.count() == 6 and sum(r.bytes for r in plan.collect()) < limit
    assert spark.read.parquet(str(out)).count() == 600
    assert same(spark.read.parquet(str(source)), maintenance.compacted(spark, str(source), str(out), plan))
    lone = tmp_path / "lone"
    rows.coalesce(1).write.parquet(str(lone))
    plan = maintenance.compact(spark, str(lone), str(tmp_path / "nothing"))
    assert plan.count() == 0 and not (tmp_path / "nothing").exists()
    assert maintenance.compacted(spark, str(lone), str(tmp_path / "nothing"), plan).count() == 60000


def test_merged_files_come_near_the_target_size(spark, tmp_path):
    source, out = tmp_path / "small", tmp_path / "mid"
    spark.range(200000).withColumn("v", F.rand(1)).repartition(40).write.parquet(str(source))
    total = sum(p.stat().st_size for p in parquet_files(source))
    plan = maintenance.compact(spark, str(source), str(out), target_bytes=total // 4)
    assert plan.select("rewrite_group").distinct().count() == 4 and len(parquet_files(out)) <= 4


def test_plan_groups_are_complete_and_near_the_target(spark):
    listing = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("folder"),
        F.concat(F.lit("f"), "id").alias("path"), ((F.col("id") % 97 + 1) * MB).alias("bytes"))
    plan = maintenance.compaction_plan(listing)
    assert plan.count() == plan.select("path").distinct().count() >= 19900  # all but files alone in a group
    groups = plan.groupBy("folder", "rewrite_group").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    assert groups.agg(F.max("b")).first()[0] <= maintenance.TARGET_FILE_BYTES + 97 * MB
    assert groups.agg(F.min("n")).first()[0] > 1


def test_maintenance_compacts_all_tables_before_it_expires(spark, tmp_path):
    """Without a table format the expiry fails, and by then both tables are merged."""
    places = {}
    for name in ("events", "orders"):
        partitioned(spark, tmp_path / name, 4)
        places[name] = (str(tmp_path / name), str(tmp_path / f"{name}-merged"))
    with pytest.raises(Exception, match="(?i)does not support procedures"):
        maintenance.maintain(spark, places, "no_such_catalog", NOW)
    for name, (source, merged) in places.items():
        assert len(parquet_files(tmp_path / f"{name}-merged")) == 3
        assert spark.read.parquet(merged).count() == spark.read.parquet(source).count()


NOW = datetime(2026, 8, 10)


# --- audit and charts ----------------------------------------------------------------------

def test_timeline_fills_missing_columns_and_sorts(spark):
    a = spark.createDataFrame([("decision", NOW, "u", "Select", "denied")],
                              "source STRING, ts TIMESTAMP_NTZ, principal STRING, action STRING, outcome STRING")
    b = spark.createDataFrame([("database", NOW - timedelta(1), "d", "orders/1")],
                              "source STRING, ts TIMESTAMP_NTZ, action STRING, target STRING")
    rows = audit.timeline(a, b).collect()
    assert [r.source for r in rows] == ["database", "decision"]
    assert rows[0].outcome is None and rows[1].target is None


@pytest.mark.parametrize("limit, want", [(100, [("A", 1), ("B", 3), ("C", 2)]), (2, [("B", 3), ("C", 2)])])
def test_status_chart(spark, limit, want):
    orders = spark.createDataFrame([(1, "B"), (2, "B"), (3, "B"), (4, "C"), (5, "C"), (6, "A"), (None, "A")],
                                   "order_id INT, status STRING")
    assert [tuple(r) for r in dashboards.orders_by_status(orders, row_limit=limit).collect()] == want
    series = dashboards.orders_by_status_series(orders).collect()
    assert sorted((r.status, r.series, r.order_count) for r in series) == [("A", "A", 1), ("B", "B", 3), ("C", "C", 2)]


def test_insert_naming_some_columns_takes_one_default_time_per_insert(spark, sf_dir):
    from pyspark.sql import functions as F

    from streamlake.plans.queries import QUERIES

    QUERIES["create_if_absent_with_default"](spark, sf_dir).count()
    name = sorted(r.namespace for r in spark.sql("SHOW DATABASES").collect() if r.namespace.startswith("shop_"))[-1]
    table = spark.table(f"{name}.customers")
    stamps = table.groupBy(F.col("customer_id") % 2).agg(F.count_distinct("created_at").alias("n")).collect()
    assert sorted(r.n for r in stamps) == [1, 1]
    assert table.where("created_at IS NULL").count() == 0
