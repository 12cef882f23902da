"""A third of all rows under one key: plans must fold or split them, and lose none.

Broadcasts are switched off, as for sides too large, and the split thresholds are set low.
"""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from streamlake.operators import access, cdc, clickstream, graph, lint, loading, maintenance
from streamlake.policy import SHIPPED

ROWS, PARTS = 60000, 16


def hot():
    return F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000)


@pytest.fixture(scope="module")
def session(spark):
    sibling = spark.newSession()
    for key, value in {
            "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true",
            "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8192"}.items():
        sibling.conf.set(key, value)
    return sibling


def rows(session, **columns):
    return session.range(0, ROWS, 1, PARTS).select("id", *[c.alias(n) for n, c in columns.items()])


def run(df):
    """Result size and final plan."""
    count = len(df.collect())
    return count, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_orders_of_a_hot_customer_are_split(session):
    minutes = session.range(1000).select(
        F.col("id").alias("user_id"), F.lit(1).alias("event_count"),
        F.lit(1).alias("total_duration_ms"), F.lit(datetime(2024, 1, 1)).alias("window_end"))
    orders = rows(session, customer_id=hot(), total_amount=F.lit(1), status=F.lit("O")) \
        .withColumnRenamed("id", "order_id")
    count, plan = run(clickstream.join_orders(minutes, orders))
    assert count == ROWS and "skew=true" in plan


def test_children_of_a_hot_parent_are_split(session):
    parents = session.range(1, 1000).withColumnRenamed("id", "pk")
    count, plan = run(loading.fk_violations(rows(session, ref=hot()), parents, "ref", "pk"))
    assert count == rows(session, ref=hot()).where("ref = 0").count()
    assert "LeftAnti" in plan and "skew=true" in plan


def requests_of(rows_):
    """Requests of one caller for table ``shape``."""
    names = ["catalogName", "schemaName", "tableName"]
    table = F.struct(F.lit("iceberg").alias(names[0]), F.lit("lake").alias(names[1]),
                     F.col("shape").alias(names[2]))
    column = F.struct(*[F.lit(None).cast("string").alias(n) for n in [*names, "columnName"]])
    schema = F.struct(*[F.lit(None).cast("string").alias(n) for n in names[:2]])
    return rows_.select(
        "id", "pad", F.struct(F.struct(F.lit("u").alias("user"), F.array(F.lit("g")).alias("groups"))
                              .alias("identity")).alias("context"),
        F.struct(F.lit("SelectFromColumns").alias("operation"), F.struct(
            table.alias("table"), column.alias("column"), schema.alias("schema"))
            .alias("resource")).alias("action"))


def hot_requests(session):
    return requests_of(rows(session, shape=F.concat(F.lit("t"), hot().cast("string")),
                            pad=F.sha2(F.col("id").cast("string"), 256)))


def declared(session):
    return session.range(0, 1000, 2).select(
        F.lit("SelectFromColumns").alias("operation"), F.lit("lake").alias("schema_name"),
        F.concat(F.lit("t"), "id").alias("table_name"), F.array(F.lit("g")).alias("holders"))


def test_requests_of_a_hot_table_are_split(session):
    decided = access.decide_allow(hot_requests(session), declared(session))
    count, plan = run(decided)
    assert count == ROWS and "skew=true" in plan
    assert decided.where("allowed").count() == rows(session, shape=hot()).where("shape % 2 = 0").count()


def test_a_log_is_read_once_and_not_shuffled_for_declared_permissions(spark, tmp_path):
    """The threshold lies below the log's size and above that of what is declared."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    hot_requests(session).write.parquet(str(tmp_path / "log"))
    log = session.read.parquet(str(tmp_path / "log"))
    decided = access.decide_allow(log, access.table_permissions(session, SHIPPED))
    count, plan = run(decided)
    assert count == ROWS
    assert plan.count("Scan parquet") == 1 and not re.search(r"(?<!Broadcast)Exchange", plan)


def test_grants_on_a_hot_resource_are_split(session):
    name = F.concat(F.lit("r"), hot())
    grants = rows(session, resource=name, grant_id=F.col("id").cast("string"),
                  privileges=F.array(F.lit("select")), allow_unmasked=F.lit(False),
                  column_mask=F.lit(None).cast("map<string,string>"))
    resources = session.range(1000).select(
        F.concat(F.lit("r"), "id").alias("resource"), F.lit("pii").alias("classification"),
        F.array(F.lit("email")).alias("sensitive_columns"))
    count, plan = run(lint.pii_unmasked(resources, grants))
    assert count == ROWS and "skew=true" in plan


def test_holders_of_a_hot_role_are_split(session):
    groups = rows(session, name=F.concat(F.lit("g"), "id"),
                  roles=F.array(F.concat(F.lit("r"), hot().cast("string"))))
    edges = session.range(1000).select(F.concat(F.lit("r"), "id").alias("role"), F.lit("top").alias("parent"))
    count, plan = run(graph.group_roles(groups, edges))
    assert count == 2 * ROWS and "skew=true" in plan


def test_changes_of_a_hot_key_are_folded_before_the_shuffle(session):
    changes = rows(session, order_id=hot(), op=F.lit("u"), ts_ms=F.col("id"), seq=F.col("id"))
    last = cdc.latest_per_key(changes, "order_id")
    _, plan = run(last)
    newest = {r.order_id: r.seq for r in last.collect()}
    want = {r.order_id: r.seq for r in changes.groupBy("order_id").agg(F.max("seq").alias("seq")).collect()}
    assert newest == want
    assert "WindowGroupLimit" in plan[plan.rindex("Exchange hashpartitioning"):]


def test_files_of_a_hot_table_are_spread_over_tasks(session):
    files = rows(session, folder=F.when(F.col("id") % 3 == 0, "hot").otherwise("t"),
                 path=F.concat(F.lit("p"), "id"), bytes=F.lit(1000).cast("bigint"))
    plan = maintenance.compaction_plan(files, target_bytes=100000)
    sizes = [r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == ROWS and max(sizes) < ROWS / 4
    assert plan.groupBy("folder", "rewrite_group").count().agg(F.max("count")).first()[0] == 100


def test_sessions_of_a_hot_user_are_folded_into_slots(session):
    clicks = rows(session, user_id=hot(), event_id=F.col("id"), duration_ms=F.lit(1),
                  timestamp=F.timestamp_seconds(F.col("id")).cast("timestamp_ntz"))
    sessions = clickstream.sessions(clicks)
    found = sessions.where("user_id = 0").collect()
    assert len(found) == 1 and found[0].event_count == clicks.where("user_id = 0").count()
    text = sessions._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in text[text.rindex("Exchange hashpartitioning"):]
