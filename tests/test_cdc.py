import json
import re
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from streamlake.functions.times import parse_iso, truncate_millis
from streamlake.operators import cdc
from streamlake.sources.topics import ORDER_ROW, decode, envelope_schema

SCHEMA = envelope_schema(ORDER_ROW)


def image(order_id, status="O", total="1.00", at="2026-08-10T10:00:00.000000Z"):
    return {"order_id": order_id, "customer_id": 1, "total_amount": total, "status": status,
            "updated_at": at}


def change(op, seq, before=None, after=None):
    return json.dumps({"before": before, "after": after, "op": op, "ts_ms": seq * 1000, "seq": seq})


def changes(spark, records):
    df = spark.createDataFrame([(r,) for r in records], "value STRING")
    return cdc.mirror_orders(cdc.normalize(decode(df, SCHEMA)))


def state(df):
    return sorted((r.order_id, r.status) for r in df.collect())


EDGE_CASES = [
    change("c", 1, None, image(1, "A")), change("u", 2, image(1, "A"), image(1, "B")),
    change("u", 3, image(1, "B"), image(1, "C")), change("c", 1, None, image(2, "A")),
    change("u", 2, image(2, "A"), image(2, "B")), change("d", 3, image(2, "B")),
    change("d", 1, image(99)), change("r", 0, None, image(3, "A")),
    change("r", 0, None, image(3, "A")), None]


def test_edge_rows(spark):
    """Two updates of one key, update then delete, delete of an unknown key, duplicate delivery,
    and a record without value."""
    rows = changes(spark, EDGE_CASES)
    assert rows.count() == 9
    assert state(cdc.current_rows(rows, "order_id")) == [(1, "C"), (3, "A")]


def test_merge_is_idempotent_and_inserts_updates_deletes(spark):
    rows = changes(spark, EDGE_CASES)
    target = changes(spark, [change("r", 0, None, image(k, "OLD")) for k in (1, 2, 7)]) \
        .drop("op", "ts_ms", "seq")
    once = cdc.merge(target, rows, "order_id")
    assert state(once) == [(1, "C"), (3, "A"), (7, "OLD")]
    assert state(cdc.merge(once, rows, "order_id")) == state(once)


@pytest.mark.parametrize("record, message", [
    (change("u", 1, None, image(1)), "usable row image"),
    (change("d", 1, None), "usable row image"),
    (change("x", 1, None, image(1)), "usable row image"),
    (change("c", 1, None, image(1, total="abc")), "CAST_INVALID_INPUT"),
    (change("c", 1, None, image(1, total="123456789.00")), "NUMERIC_VALUE_OUT_OF_RANGE"),
    (change("c", 1, None, image(1, at="yesterday")), "CAST_INVALID_INPUT"),
    ('{"op": ', "MALFORMED_RECORD_IN_PARSING")])
def test_bad_records_fail_the_job(spark, record, message):
    with pytest.raises(Exception, match=message):
        changes(spark, [record]).collect()


def test_position_falls_back_to_the_log_sequence_number(spark):
    records = [json.dumps({"before": None, "after": image(1, s), "op": "c", "ts_ms": 5,
                           "source": {"lsn": lsn, "table": "orders"}}) for s, lsn in (("B", 9), ("A", 8))]
    assert state(cdc.current_rows(changes(spark, records), "order_id")) == [(1, "B")]


def test_amounts_round_half_up(spark):
    rows = changes(spark, [change("c", 1, None, image(1, total="2.345"))])
    assert str(rows.first()["total_amount"]) == "2.35"


@pytest.mark.parametrize("text, want", [
    ("2026-08-10T10:00:00.123999Z", datetime(2026, 8, 10, 10, 0, 0, 123000)),
    ("2026-08-10T10:00:00Z", datetime(2026, 8, 10, 10)),
    ("2026-08-10 10:00:00.5", datetime(2026, 8, 10, 10, 0, 0, 500000)),
    ("1969-12-31T23:59:59.999999Z", datetime(1969, 12, 31, 23, 59, 59, 999000))])
def test_iso_timestamps(spark, text, want):
    row = spark.createDataFrame([(text,)], "s STRING").select(parse_iso(F.col("s")).alias("t"))
    assert row.first()["t"] == want
    assert row.dtypes == [("t", "timestamp_ntz")]


def test_millis_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 does not exist on that day in that zone
        row = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.123456' AS t")
        assert row.select(truncate_millis(F.col("t")).alias("t")).first()["t"] == \
            datetime(2024, 3, 10, 2, 30, 0, 123000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


ops = st.lists(st.tuples(st.integers(0, 4), st.sampled_from("cud")), max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(ops, st.integers(0, 25))
def test_replaying_any_log_in_two_parts_equals_replaying_it_at_once(spark, log, cut):
    records = [change(op, i + 1, image(k, f"s{i - 1}"), None if op == "d" else image(k, f"s{i}"))
               for i, (k, op) in enumerate(log)] + [change("r", 0, None, image(9))]
    want = {9: "O"}
    for i, (k, op) in enumerate(log):
        want.pop(k, None) if op == "d" else want.update({k: f"s{i}"})
    rows = changes(spark, records)
    first = cdc.current_rows(rows.where(F.col("seq") <= cut), "order_id").drop("seq")
    assert state(cdc.merge(first, rows.where(F.col("seq") > cut), "order_id")) == sorted(want.items())
    assert state(cdc.as_of(rows, "order_id", 10 ** 12)) == sorted(want.items())


def test_small_change_sets_leave_the_target_unshuffled(spark, tmp_path):
    """Changes from a scan; the threshold lies below the target's size and above that of the keys."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    session.range(100000).select(F.col("id").alias("order_id"), F.sha2(F.col("id").cast("string"), 256)
                                 .alias("status")).write.parquet(str(tmp_path / "target"))
    session.range(50).select((F.col("id") % 9).alias("order_id"), F.lit("new").alias("status"), F.lit("u").alias("op"),
                             F.col("id").alias("ts_ms"), F.col("id").alias("seq")).write.parquet(str(tmp_path / "log"))
    merged = cdc.merge(session.read.parquet(str(tmp_path / "target")), session.read.parquet(str(tmp_path / "log")),
                       "order_id")
    assert merged.where("status = 'new'").count() == 9
    merged.collect()
    text = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "LeftAnti" in text and not re.search(r"(?<!Broadcast)Exchange", text)
    assert "from_json" not in text


def test_equal_positions_give_the_same_image_every_time(spark):
    rows = spark.createDataFrame([(1, s, "u", 5, 5) for s in "abcdef"],
                                 "order_id INT, status STRING, op STRING, ts_ms BIGINT, seq BIGINT")
    images = {cdc.latest_per_key(rows.repartition(n), "order_id").first().status for n in (1, 2, 3, 5)}
    assert len(images) == 1
    gone = rows.unionByName(rows.limit(1).withColumn("op", F.lit("d")))
    assert cdc.current_rows(gone, "order_id").count() == 0


def test_ranking_is_also_applied_ahead_of_the_shuffle(spark):
    rows = changes(spark, EDGE_CASES)
    text = cdc.latest_per_key(rows, "order_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text[text.rindex("Exchange hashpartitioning"):]


def test_chunked_snapshot_rows_overtaken_in_their_window_lose(spark):
    from pyspark.sql import functions as F

    from streamlake.operators import cdc

    # chunk 0 (keys 0-9) read between positions 100 and 200, chunk 1 (keys 10-19) between 300 and 400
    windows = spark.createDataFrame([(0, 100, 200), (1, 300, 400)], "chunk long, low long, high long")
    snapshot = spark.createDataFrame(
        [(1, "old", 0), (2, "same", 0), (11, "read", 1), (12, "gone later", 1)], "k long, v string, chunk long")
    tail = spark.createDataFrame(
        [(1, "new", "u", 150),      # inside chunk 0's window: the snapshot row may not show it, and loses
         (11, "before", "u", 250),  # before chunk 1's window: the snapshot row already shows it
         (12, None, "d", 450),      # after the window: the log's delete comes last
         (3, "born", "c", 120)],    # a key the snapshot never saw
        "k long, v string, op string, position long")
    stream = cdc.chunked_bootstrap(snapshot, windows, tail, "k", lambda k: F.floor(k / 10).cast("long"))
    state = cdc.current_rows(stream.withColumns({"seq": F.col("position"), "ts_ms": F.col("position")}), "k")
    assert sorted((r.k, r.v) for r in state.collect()) == [(1, "new"), (2, "same"), (3, "born"), (11, "read")]
