"""Streams against the batch result of the same operators on the same rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamlake.operators import cdc, clickstream
from streamlake.session import streaming_session
from streamlake.sources import derive
from streamlake.sources.tables import load
from streamlake.sources.topics import (CLICK_SCHEMA, CUSTOMER_ROW, ORDER_ROW, decode, encode,
                                       envelope_schema, topic_options)
from streamlake.streaming import jobs

T0 = datetime(2024, 1, 1)


@pytest.fixture
def session(spark):
    return streaming_session(spark)


def put(df, folder):
    df.coalesce(1).write.mode("append").text(folder)


def records(session, folder):
    return session.readStream.schema("value STRING").option("maxFilesPerTrigger", 1).text(folder)


def clicks(session, seconds, start=0):
    rows = [(f"e{start + i}", "u", None, "view", T0 + timedelta(seconds=s), 1)
            for i, s in enumerate(seconds)]
    return encode(session.createDataFrame(rows, CLICK_SCHEMA))


def minutes(session, path):
    return sorted((r.window_start.minute, r.event_count)
                  for r in session.read.parquet(path).collect())


def test_each_window_is_written_once_when_it_closes(session, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    put(clicks(session, [1, 2, 64]), source)
    jobs.run_tumble(records(session, source), out, check, jobs.DRAIN).awaitTermination()
    assert minutes(session, out) == []           # watermark 00:59, first window still open
    put(clicks(session, [66], 10), source)
    jobs.run_tumble(records(session, source), out, check, jobs.DRAIN).awaitTermination()
    assert minutes(session, out) == [(0, 2)]     # watermark 01:01
    jobs.run_tumble(records(session, source), out, check, jobs.DRAIN).awaitTermination()
    assert minutes(session, out) == [(0, 2)]     # a restart adds nothing


def test_rows_of_closed_windows_are_dropped(session, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    dropped = []
    for seconds in ([1, 2], [70], [3, 71], [140]):
        put(clicks(session, seconds), source)
        query = jobs.run_tumble(records(session, source), out, check, jobs.DRAIN)
        query.awaitTermination()
        dropped.append(jobs.late_rows(query))
    assert minutes(session, out) == [(0, 2), (1, 2)]
    assert dropped == [0, 0, 1, 0]


def test_tumble_equals_batch_but_for_open_windows(session, sf_dir, tmp_path):
    """Fed in time order over several files, whose boundaries cut through minutes."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    events = load(session, sf_dir, "events")
    bounds = [datetime(2023, 1, 1), datetime(2024, 1, 10, 5, 3, 20), datetime(2024, 1, 20),
              datetime(2025, 1, 1)]
    for lower, upper in zip(bounds, bounds[1:]):
        part = events.where((F.col("ts") >= lower) & (F.col("ts") < upper))
        put(encode(derive.click_records(part)), source)
    jobs.run_tumble(records(session, source), out, check, jobs.DRAIN).awaitTermination()
    last = events.agg(F.max("ts")).first()[0] - timedelta(seconds=5)
    batch = clickstream.tumble(derive.click_records(events)).where(F.col("window_end") <= last)
    stream = session.read.parquet(out).select(batch.columns)
    assert stream.count() > 900
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


def test_malformed_event_fails_the_stream(session, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    put(session.createDataFrame([('{"event_id": "e", "duration_ms": "x"}',)], "value STRING"), source)
    query = jobs.run_tumble(records(session, source), out, check, jobs.DRAIN)
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        query.awaitTermination()


def test_two_mirrors_run_side_by_side_and_restart_cleanly(session, sf_dir, tmp_path):
    customer, nation = load(session, sf_dir, "customer"), load(session, sf_dir, "nation")
    logs = {"orders": derive.order_changes(load(session, sf_dir, "orders")),
            "customers": derive.customer_changes(customer, nation)}
    for name, log in logs.items():
        for seq in range(3):
            put(encode(log.where(F.col("seq") == seq)), str(tmp_path / name / "in"))

    def run():
        started = [start(records(session, str(tmp_path / name / "in")),
                         str(tmp_path / name / "deltas"), str(tmp_path / name / "check"), jobs.DRAIN)
                   for name, start in (("orders", jobs.run_orders_upsert),
                                       ("customers", jobs.run_customers_upsert))]
        for query in started:
            query.awaitTermination()

    def image(name, key, **options):
        return jobs.current_image(session, str(tmp_path / name / "deltas"), key, **options)

    run()
    want_orders = cdc.current_rows(cdc.mirror_orders(cdc.normalize(logs["orders"])), "order_id")
    want_customers = cdc.current_rows(
        cdc.mirror_customers(cdc.normalize(logs["customers"])), "customer_id")
    for _ in range(2):
        for have, want in ((image("orders", "order_id"), want_orders),
                           (image("customers", "customer_id"), want_customers)):
            have = have.select(want.columns)
            assert have.count() == want.count()
            assert have.exceptAll(want).count() == 0
        run()

    # folding the first changes into a base does not change the image
    base = str(tmp_path / "base")
    jobs.fold(session, str(tmp_path / "orders" / "deltas"), "order_id", base, upto=0)
    folded = image("orders", "order_id", base=base).drop("seq").select(
        [c for c in want_orders.columns if c != "seq"])
    want_orders = want_orders.drop("seq")
    assert folded.exceptAll(want_orders).count() == 0 and folded.count() == want_orders.count()


def test_readers_never_see_a_batch_that_did_not_commit(session, tmp_path):
    """Files of a batch that broke off lie in the folder, but only a commit makes a batch count, and a
    run after the failure writes its changes once."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    log = derive.order_changes(session.range(40).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        F.lit(1.5).cast("decimal(10,2)").alias("o_totalprice"),
        F.lit(T0).cast("timestamp_ntz").alias("o_orderdate")))
    put(encode(log.where("seq = 0")), source)
    jobs.run_orders_upsert(records(session, source), out, check, jobs.DRAIN).awaitTermination()
    first = jobs.current_image(session, out, "order_id").count()
    (session.read.parquet(out).withColumn("seq", F.lit(99).cast("bigint"))
     .coalesce(1).write.parquet(str(tmp_path / "stray")))
    stray = next((tmp_path / "stray").glob("*.parquet"))
    (tmp_path / "out" / f"{stray.name}").write_bytes(stray.read_bytes())
    assert session.read.parquet(out).where("seq = 99").count() == 0
    put(encode(log.where("seq > 0")), source)
    for _ in range(2):
        jobs.run_orders_upsert(records(session, source), out, check, jobs.DRAIN).awaitTermination()
    assert session.read.parquet(out).count() == log.count() and first == 40
    assert jobs.current_image(session, out, "order_id").count() == 36


def test_topics_are_read_from_the_start():
    assert topic_options("host:9092", "events.clickstream") == {
        "kafka.bootstrap.servers": "host:9092", "subscribe": "events.clickstream",
        "startingOffsets": "earliest"}


def test_binary_values_decode(session):
    rows = session.createDataFrame([(bytearray(b'{"order_id": 1}'),), (None,)], "value BINARY")
    assert [r.order_id for r in decode(rows, "order_id BIGINT").collect()] == [1]


def test_interval_join_drops_state_as_watermarks_pass(spark, sf_dir, tmp_path):
    """Both sides in four time-ordered parts: every match is found once, and rows whose time range
    the watermarks have passed leave the join's state."""
    from pyspark.sql import functions as F

    from streamlake.operators import clickstream
    from streamlake.session import streaming_session
    from streamlake.sources import derive
    from streamlake.sources.tables import load
    from streamlake.sources.topics import encode
    from streamlake.streaming import jobs

    events = load(spark, sf_dir, "events")
    placements = derive.order_placements(load(spark, sf_dir, "orders"))
    batch = clickstream.orders_after_clicks(derive.click_records(events), placements)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * k / 4 for k in range(1, 4)]
    session = streaming_session(spark)
    held = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        def within(c):
            return (F.lit(True) if low is None else c >= F.lit(low)) & (F.lit(True) if high is None else c < F.lit(high))
        encode(derive.click_records(events.where(within(F.col("ts"))))).select("value") \
            .write.mode("append").text(str(tmp_path / "clicks"))
        placements.where(within(F.col("placed_at"))).write.mode("append").parquet(str(tmp_path / "orders"))
        run = jobs.run_orders_after_clicks(
            session.readStream.schema("value STRING").text(str(tmp_path / "clicks")),
            session.readStream.schema(placements.schema).parquet(str(tmp_path / "orders")),
            str(tmp_path / "table"), str(tmp_path / "checkpoint"), jobs.DRAIN)
        run.awaitTermination()
        held.append(sum(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress[-1:]))
    got = spark.read.parquet(str(tmp_path / "table"))
    assert sorted(got.collect()) == sorted(batch.collect())
    total = events.count() + placements.count()
    assert max(held) < total / 2  # the state never holds all rows: it is dropped as time passes
