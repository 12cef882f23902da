"""Registered queries. Each takes a session and a table folder and returns a DataFrame over the
whole of its tables."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from streamlake.operators import (access, audit, cdc, clickstream, dashboards, drift, graph, lint,
                                  loading, maintenance, privileges)
from streamlake.policy import SHIPPED, Grant, Policy
from streamlake.session import configure, run_dir, streaming_session
from streamlake.sources import derive
from streamlake.sources.tables import ensure_table, load, table_path
from streamlake.sources.topics import (CLICK_SCHEMA, CUSTOMER_ROW, ORDER_ROW, decode, encode,
                                       envelope_schema, stream_table)
from streamlake.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


# --- shared inputs -------------------------------------------------------------------------

def _clicks(spark, sf_dir):
    return derive.clickstream(load(spark, sf_dir, "events"))


def _minutes(spark, sf_dir):
    return clickstream.tumble(_clicks(spark, sf_dir))


def _orders(spark, sf_dir):
    return derive.shop_orders(load(spark, sf_dir, "orders"))


def _customers(spark, sf_dir):
    return derive.shop_customers(load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation"))


def _order_records(spark, sf_dir):
    return encode(derive.order_changes(load(spark, sf_dir, "orders")))


def _order_changes(spark, sf_dir):
    records = _order_records(spark, sf_dir)
    return cdc.mirror_orders(cdc.normalize(decode(records, envelope_schema(ORDER_ROW))))


def _role_edges(spark, sf_dir):
    return derive.role_edges(load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation"))


def _requests(spark, sf_dir, plural=False):
    return derive.access_requests(load(spark, sf_dir, "events"), plural)


# --- clickstream ---------------------------------------------------------------------------

@query
def clickstream_tumble(spark, sf_dir):
    return _minutes(spark, sf_dir)


@query
def clickstream_sessions(spark, sf_dir):
    return clickstream.sessions(_clicks(spark, sf_dir))


@query
def daily_rollup(spark, sf_dir):
    return clickstream.daily(_minutes(spark, sf_dir))


@query
def daily_rollup_incremental(spark, sf_dir):
    """The daily roll-up kept up by three batches: the first and the second half of the events,
    then every 50th event of the first half, held back till last, which touches old days again."""
    early, late = _halves(spark, sf_dir)
    table = run_dir(spark, "rollup")
    batches = [early.where("event_id % 50 <> 0"), late, early.where("event_id % 50 = 0")]
    for n, events in enumerate(batches):
        clickstream.add_to_rollup(clickstream.tumble(derive.clickstream(events)), table, f"{table}/staging-{n}")
    return spark.read.parquet(f"{table}/daily").select("day", "user_minutes", "event_count", "total_duration_ms")


@query
def events_orders_join(spark, sf_dir):
    return clickstream.join_orders(_minutes(spark, sf_dir), _orders(spark, sf_dir))


@query
def events_orders_interval(spark, sf_dir):
    """Clicks with the orders their user placed within the hour after (batch)."""
    clicks = derive.click_records(load(spark, sf_dir, "events"))
    return clickstream.orders_after_clicks(clicks, derive.order_placements(load(spark, sf_dir, "orders")))


@query
def events_to_json(spark, sf_dir):
    return encode(derive.click_records(load(spark, sf_dir, "events")), key="user_id")


@query
def clickstream_decode(spark, sf_dir):
    return decode(events_to_json(spark, sf_dir), CLICK_SCHEMA)


@query
def stream_clickstream_tumble(spark, sf_dir):
    return _drain_clicks(spark, sf_dir, jobs.run_tumble, "tumble")


@query
def stream_clickstream_sessions(spark, sf_dir):
    return _drain_clicks(spark, sf_dir, jobs.run_sessions, "sessions")


def _drain_clicks(spark, sf_dir, run, name):
    out = run_dir(spark, name)
    session = streaming_session(spark)
    schema = load(spark, sf_dir, "events").schema
    records = encode(derive.click_records(
        stream_table(session, table_path(sf_dir, "events"), schema)))
    run(records, f"{out}/table", f"{out}/checkpoint", jobs.DRAIN).awaitTermination()
    return spark.read.parquet(f"{out}/table")


# --- change-data capture -------------------------------------------------------------------

@query
def cdc_orders_normalize(spark, sf_dir):
    return cdc.normalize(decode(_order_records(spark, sf_dir), envelope_schema(ORDER_ROW)))


@query
def cdc_orders_mirror(spark, sf_dir):
    return _order_changes(spark, sf_dir)


@query
def cdc_customers_mirror(spark, sf_dir):
    changes = derive.customer_changes(load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation"))
    return cdc.mirror_customers(cdc.normalize(
        decode(encode(changes), envelope_schema(CUSTOMER_ROW))))


@query
def cdc_bootstrap_union(spark, sf_dir):
    return cdc.bootstrap(_orders(spark, sf_dir), _order_changes(spark, sf_dir))


@query
def cdc_orders_merge(spark, sf_dir):
    tail = _order_changes(spark, sf_dir).where("op <> 'r'")
    return cdc.merge(_orders(spark, sf_dir), tail, "order_id")


CHUNK_KEYS = 1000  # order ids of one snapshot chunk
CHUNK_READ_MS = 3 * 86_400_000  # log time that passes while a chunk is read


@query
def cdc_chunked_bootstrap(spark, sf_dir):
    """The orders mirror from a snapshot read in chunks of 1000 ids across the second half of the log,
    each chunk read over three days of log and showing the state halfway through, plus the log from the
    first chunk on; equals the merge of the whole log."""
    changes = _order_changes(spark, sf_dir).withColumn("position", F.col("ts_ms"))
    first, last, top = changes.agg(F.min("ts_ms"), F.max("ts_ms"), F.max("order_id")).first()
    start, count = (first + last) // 2, top // CHUNK_KEYS + 1

    def chunk_of(key):
        return F.floor(key / CHUNK_KEYS).cast("long")

    windows = spark.range(count).select(
        F.col("id").alias("chunk"),
        (F.lit(start) + F.floor(F.lit(last - start) * F.col("id") / count)).cast("long").alias("low")) \
        .withColumn("high", F.col("low") + CHUNK_READ_MS)
    seen = (changes.withColumn("chunk", chunk_of(F.col("order_id"))).join(windows, "chunk")
            .where(F.col("ts_ms") <= (F.col("low") + F.col("high")) / 2).drop("low", "high"))
    snapshot = cdc.latest_per_key(seen, "order_id").where("op <> 'd'").drop("op", "ts_ms", "seq", "position")
    stream = cdc.chunked_bootstrap(snapshot, windows, changes.where(F.col("ts_ms") > start), "order_id",
                                   chunk_of)
    merged = cdc.current_rows(stream.withColumn("seq", F.col("position")), "order_id")
    return merged.drop("seq", "position")


@query
def orders_as_of(spark, sf_dir):
    # 1998-01-01T00:00:00Z
    return cdc.as_of(_order_changes(spark, sf_dir), "order_id", 883612800000)


@query
def orders_history(spark, sf_dir):
    """Every image of every order with the time span it was valid."""
    return cdc.history(_order_changes(spark, sf_dir), "order_id").select(
        "order_id", "customer_id", "total_amount", "status", "valid_from", "valid_to")


@query
def events_with_order_state(spark, sf_dir):
    """Each click with the state of every order of its user at the click's time."""
    clicks = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    joined = clickstream.with_state_at(clicks, orders_history(spark, sf_dir), "user_id", "customer_id")
    return joined.select("event_id", "user_id", "ts", "order_id", "status", "total_amount")


@query
def stream_cdc_upsert(spark, sf_dir):
    out = run_dir(spark, "orders-mirror")
    session = streaming_session(spark)
    schema = load(spark, sf_dir, "orders").schema
    records = encode(derive.order_changes(
        stream_table(session, table_path(sf_dir, "orders"), schema)))
    jobs.run_orders_upsert(records, f"{out}/changes", f"{out}/checkpoint",
                           jobs.DRAIN).awaitTermination()
    return jobs.current_image(spark, f"{out}/changes", "order_id").drop("seq")


@query
def stream_cdc_upsert_customers(spark, sf_dir):
    out = run_dir(spark, "customers-mirror")
    session = streaming_session(spark)
    schema = load(spark, sf_dir, "customer").schema
    records = encode(derive.customer_changes(
        stream_table(session, table_path(sf_dir, "customer"), schema),
        load(session, sf_dir, "nation")))
    jobs.run_customers_upsert(records, f"{out}/changes", f"{out}/checkpoint",
                              jobs.DRAIN).awaitTermination()
    return jobs.current_image(spark, f"{out}/changes", "customer_id").drop("seq")


def _drain_in_parts(spark, name, parts, run):
    """Append each part of a log to a folder and work it off by a run of its own on the same
    checkpoint; the last run finds nothing new."""
    out = run_dir(spark, name)
    session = streaming_session(spark)
    for part in [*parts, None]:
        if part is not None:
            part.select("value").write.mode("append").text(f"{out}/log")
        log = session.readStream.schema("value STRING").text(f"{out}/log")
        run(log, f"{out}/table", f"{out}/checkpoint", jobs.DRAIN).awaitTermination()
    return f"{out}/table"


def _halves(spark, sf_dir):
    """The events before and from the middle of their time span."""
    events = load(spark, sf_dir, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(first + (last - first) / 2).cast("timestamp_ntz")
    return events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle)


def _records(events):
    return encode(derive.click_records(events))


@query
def stream_tumble_restart(spark, sf_dir):
    """Three runs on one checkpoint: every closed window once."""
    return spark.read.parquet(_drain_in_parts(
        spark, "tumble-restart", map(_records, _halves(spark, sf_dir)), jobs.run_tumble))


@query
def stream_events_orders_join(spark, sf_dir):
    """The interval join of clicks and placements as two streams, stopped and restarted in the middle
    of their time span: both logs in two parts, a run after each, and a last run that finds nothing."""
    out = run_dir(spark, "orders-after-clicks")
    session = streaming_session(spark)
    early, late = _halves(spark, sf_dir)
    placements = derive.order_placements(load(spark, sf_dir, "orders"))
    middle = late.agg(F.min("ts")).first()[0]
    parts = [(early, placements.where(F.col("placed_at") < F.lit(middle))),
             (late, placements.where(F.col("placed_at") >= F.lit(middle)))]
    for part in [*parts, None]:
        if part is not None:
            _records(part[0]).select("value").write.mode("append").text(f"{out}/clicks")
            part[1].write.mode("append").parquet(f"{out}/orders")
        clicks = session.readStream.schema("value STRING").text(f"{out}/clicks")
        orders = session.readStream.schema(placements.schema).parquet(f"{out}/orders")
        jobs.run_orders_after_clicks(clicks, orders, f"{out}/table", f"{out}/checkpoint",
                                     jobs.DRAIN).awaitTermination()
    return spark.read.parquet(f"{out}/table")


@query
def stream_late_rows(spark, sf_dir):
    """Every 50th event of the first half comes last, when its window has long closed."""
    early, rest = _halves(spark, sf_dir)
    parts = [early.where("event_id % 50 <> 0"), rest, early.where("event_id % 50 = 0")]
    return spark.read.parquet(_drain_in_parts(
        spark, "late-rows", map(_records, parts), jobs.run_tumble))


@query
def stream_upsert_restart(spark, sf_dir):
    """The change log in three parts, each by a run of its own, folded after the second."""
    log = derive.order_changes(load(spark, sf_dir, "orders"))
    path = _drain_in_parts(spark, "orders-restart",
                           [encode(log.where(F.col("seq") == n)) for n in range(3)],
                           jobs.run_orders_upsert)
    base = run_dir(spark, "orders-base")
    jobs.fold(spark, path, "order_id", base, upto=1)
    return jobs.current_image(spark, path, "order_id", base).drop("seq")


# --- loading -------------------------------------------------------------------------------

@query
def insert_ignore_conflict(spark, sf_dir):
    """Every sixth customer is in place; all come in, under a key three neighbours share."""
    rows = _customers(spark, sf_dir).select("customer_id", "name", "city", F.concat(
        F.lit("user"), F.floor(F.col("customer_id") / 3), F.lit("@example.com")).alias("email"))
    target = rows.where("customer_id % 6 = 0")
    return loading.insert_ignore(target, rows, "email", "customer_id")


@query
def seed_insert_if_empty(spark, sf_dir):
    target = _orders(spark, sf_dir).select("customer_id", "total_amount", "status")
    return loading.insert_if_empty(target, loading.seed(spark, loading.SEED_ORDERS))


@query
def seed_insert_into_empty(spark, sf_dir):
    """Orders of a status that does not occur: an empty table, which the seed enters."""
    target = _orders(spark, sf_dir).where("status = 'NONE'").select(
        "customer_id", "total_amount", "status")
    return loading.insert_if_empty(target, loading.seed(spark, loading.SEED_ORDERS))


def _shared_mail(spark, sf_dir):
    return _customers(spark, sf_dir).withColumn("email", F.concat(
        F.lit("user"), F.floor(F.col("customer_id") / 3), F.lit("@example.com")))


@query
def unique_violations(spark, sf_dir):
    """Mail addresses that three neighbours share."""
    return loading.unique_violations(_shared_mail(spark, sf_dir), "email")


@query
def duplicate_minutes(spark, sf_dir):
    """Minutes written once more by a second job over the purchases."""
    again = clickstream.tumble(_clicks(spark, sf_dir).where("action = 'purchase'"))
    return loading.unique_violations(_minutes(spark, sf_dir).unionByName(again),
                                     "user_id", "window_start")


@query
def not_null_violations(spark, sf_dir):
    """Every 7th customer lacks the address, every 9th the city."""
    key = F.col("customer_id")
    rows = _customers(spark, sf_dir).withColumns({
        "email": F.when(key % 7 != 0, F.col("email")), "city": F.when(key % 9 != 0, F.col("city"))})
    return loading.not_null_violations(rows, "customer_id", "name", "email", "city")


@query
def length_violations(spark, sf_dir):
    """Every 5th customer's city is written ten times over."""
    city = F.when(F.col("customer_id") % 5 == 0, F.repeat("city", 10)).otherwise(F.col("city"))
    return loading.length_violations(_customers(spark, sf_dir).withColumn("city", city),
                                     "customer_id", name=100, email=100, city=50)


@query
def fk_violations(spark, sf_dir):
    """Every 50th order refers to a customer that does not exist, every 70th to none."""
    key = (F.when(F.col("order_id") % 50 == 0, -F.col("customer_id") - 1)
           .when(F.col("order_id") % 70 != 0, F.col("customer_id")))
    child = _orders(spark, sf_dir).withColumn("customer_id", key)
    return loading.fk_violations(child, _customers(spark, sf_dir), "customer_id", "customer_id")


# --- dashboards ----------------------------------------------------------------------------

@query
def dash_events_per_minute(spark, sf_dir):
    return dashboards.events_per_minute(_minutes(spark, sf_dir))


@query
def dash_orders_by_status(spark, sf_dir):
    return dashboards.orders_by_status(cdc_orders_merge(spark, sf_dir))


@query
def dash_orders_by_status_series(spark, sf_dir):
    return dashboards.orders_by_status_series(cdc_orders_merge(spark, sf_dir))


@query
def table_row_count(spark, sf_dir):
    return dashboards.row_count(load(spark, sf_dir, "lineitem"))


# --- maintenance ---------------------------------------------------------------------------

@query
def compaction_rewrite(spark, sf_dir):
    """The orders by status in many small files, merged."""
    orders = load(spark, sf_dir, "orders")
    source, merged = run_dir(spark, "fragments"), run_dir(spark, "compaction")
    orders.repartition(32).write.partitionBy("o_orderstatus").parquet(source)
    plan = maintenance.compact(spark, source, merged)
    return maintenance.compacted(spark, source, merged, plan).select(*orders.columns)


@query
def create_if_absent_with_default(spark, sf_dir):
    """A customers table in the catalog, created if absent with a creation time that defaults to the
    time of the insert, filled by two inserts that name only id and name (even ids, then odd ones)."""
    namespace = f"shop_{uuid.uuid4().hex[:12]}"  # this run's own namespace in the shared warehouse
    columns = "customer_id BIGINT, name STRING, created_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP()"
    ensure_table(spark, namespace, "customers", columns)
    ensure_table(spark, namespace, "customers", columns)  # exists: left alone
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    for parity in (0, 1):
        spark.sql(f"INSERT INTO {namespace}.customers (customer_id, name) "
                  "SELECT id, name FROM {rows} WHERE id % 2 = {parity}", rows=customers, parity=parity)
    table = spark.table(f"{namespace}.customers")
    return table.select("customer_id", "name", F.col("created_at").isNotNull().alias("stamped"))


@query
def retention_after_compaction(spark, sf_dir):
    """The orders by status in many small files, merged, and the merged files expired by a clock eight
    days after the newest file: the table read afterwards has the same rows."""
    orders = load(spark, sf_dir, "orders")
    source, merged = run_dir(spark, "fragments"), run_dir(spark, "compaction")
    orders.repartition(32).write.partitionBy("o_orderstatus").parquet(source)
    plan = maintenance.compact(spark, source, merged)
    newest = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
              .agg(F.max("modificationTime")).first()[0])
    maintenance.expire_superseded(spark, source, plan, newest + datetime.timedelta(days=8))
    return maintenance.compacted(spark, source, merged, plan).select(*orders.columns)


# --- governed views ------------------------------------------------------------------------

def _one_grant(resource: str, *grants: Grant) -> Policy:
    return Policy(SHIPPED.roles, SHIPPED.groups, {resource: ("internal", ())}, grants, ())


def _customers_as(spark, sf_dir, user="user_1", **options):
    grant = Grant("lake.customers", ("analysts",), ("select",), **options)
    return access.secure_view(_customers(spark, sf_dir), _one_grant("lake.customers", grant),
                              "lake.customers", ["analysts"], user)


@query
def mask_hash(spark, sf_dir):
    return _customers_as(spark, sf_dir, column_mask={"email": "hash"})


@query
def mask_partial(spark, sf_dir):
    return _customers_as(spark, sf_dir, column_mask={"email": "partial", "name": "partial"})


@query
def mask_null(spark, sf_dir):
    return _customers_as(spark, sf_dir, column_mask={"email": "null", "created_at": "null"})


@query
def row_filter_compare(spark, sf_dir):
    """Two grants, two filters: both apply."""
    grants = [Grant("lake.customers", ("analysts",), ("select",), row_filter=text)
              for text in ("customer_id >= 100", "city <> 'NATION_3'")]
    return access.secure_view(_customers(spark, sf_dir), _one_grant("lake.customers", *grants),
                              "lake.customers", ["analysts"], "user_1")


@query
def row_filter_in(spark, sf_dir):
    return _customers_as(spark, sf_dir, row_filter="city IN ('NATION_1', 'NATION_7')")


@query
def row_filter_current_user(spark, sf_dir):
    return _customers_as(spark, sf_dir, user="Customer#000000042", row_filter="name = current_user")


def _orders_as(spark, sf_dir, text):
    grant = Grant("lake.orders", ("analysts",), ("select",), row_filter=text)
    return access.secure_view(_orders(spark, sf_dir), _one_grant("lake.orders", grant),
                              "lake.orders", ["analysts"], "user_1")


@query
def row_filter_and_chain(spark, sf_dir):
    return _orders_as(spark, sf_dir, "status = 'O' AND total_amount >= 1000.50 AND order_id > 7")


@query
def row_filter_or_chain(spark, sf_dir):
    return _orders_as(spark, sf_dir, "status = 'F' OR total_amount < 5000 OR customer_id IN (1, 2)")


# --- decisions -----------------------------------------------------------------------------

@query
def authz_decide_deny(spark, sf_dir):
    return access.decide_deny(_requests(spark, sf_dir)).select(
        "request_id", F.col("action.operation").alias("operation"), "deny_analyst_pii",
        "deny_analyst_write", "deny_engineer_system", "deny_unknown_pii", "allowed")


@query
def decisions_as_of_policy(spark, sf_dir):
    """Every request decided by the table policy in force at its time."""
    events = load(spark, sf_dir, "events")
    decided = access.decide_in_force(derive.access_requests(events, False), derive.policy_changes(events))
    return decided.select("request_id", "table_name", F.col("policy.version").alias("policy_version"),
                          "protected", "allowed")


@query
def visible_rows_by_role(spark, sf_dir):
    """Rows and open columns of the orders table for every role at once."""
    policy = Policy(SHIPPED.roles, SHIPPED.groups, {}, (
        Grant("lake.orders", ("analysts",), ("select",), {"total_amount": "null"}, "status = 'O'"),
        Grant("lake.orders", ("analysts", "engineers"), ("select",), row_filter="order_id > 100"),
        Grant("lake.orders", ("engineers",), ("select",), {"customer_id": "hash"}, "total_amount >= 1000.50"),
        Grant("lake.orders", ("admins",), ("select",))), ())
    return access.visible_by_role(_orders(spark, sf_dir), policy, "lake.orders")


@query
def authz_topic_decide(spark, sf_dir):
    return access.decide_topic(derive.topic_requests(load(spark, sf_dir, "events"))).select(
        "request_id", F.col("action.operation").alias("operation"), "allowed")


@query
def topic_acl_matrix(spark, sf_dir):
    requests = derive.topic_requests(load(spark, sf_dir, "events"))
    return access.decide_topic_acl(requests, access.topic_acls(spark)).select(
        "request_id", "account", "resource_type", "operation", "allowed")


@query
def authz_decide_allow(spark, sf_dir):
    permissions = access.table_permissions(spark, SHIPPED)
    return access.decide_allow(_requests(spark, sf_dir, plural=True), permissions).select(
        "request_id", "user", "operation", "catalog_name", "table_name", "allowed")


@query
def authz_row_rules(spark, sf_dir):
    """Filters and masks that apply to each request, by three grants on two tables."""
    policy = Policy(SHIPPED.roles, SHIPPED.groups, {}, (
        Grant("lake.orders", ("analysts",), ("select",), {"total_amount": "null"}, "status = 'O'"),
        Grant("lake.orders", ("analysts", "engineers"), ("select",), row_filter="order_id > 0"),
        Grant("lake.customers", ("engineers",), ("select",), {"email": "hash", "name": "partial"})), ())
    found = access.governing_rules(_requests(spark, sf_dir, plural=True),
                                   access.table_rules(spark, policy))
    return found.select("request_id", "table_name", F.array_join("row_filters", " and ").alias("row_filters"),
                        F.array_join("masks", ",").alias("masks"))


@query
def authz_catalog_ops(spark, sf_dir):
    return access.decide_catalog(_requests(spark, sf_dir, plural=True),
                                 access.catalog_permissions(spark, SHIPPED)).select(
        "request_id", "user", "operation", "catalog", "allowed")


@query
def authz_visible_tables(spark, sf_dir):
    return access.visible_objects(_requests(spark, sf_dir, plural=True),
                                  access.catalog_permissions(spark, SHIPPED)).select(
        "request_id", "user", "operation", "catalog", "schema_name", "table_name")


@query
def app_role_map(spark, sf_dir):
    """Application role of each customer's login group; unknown groups get the default."""
    users = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        derive.pick(["admins", "engineers", "analysts", "guests"], F.col("c_custkey") % 4)
        .alias("group_name"))
    return access.app_roles(users)


# --- roles and privileges ------------------------------------------------------------------

@query
def role_closure(spark, sf_dir):
    return graph.expand_roles(_role_edges(spark, sf_dir))


@query
def role_holders(spark, sf_dir):
    return graph.role_holders(_role_edges(spark, sf_dir))


@query
def group_effective_roles(spark, sf_dir):
    return graph.group_roles(derive.team_groups(load(spark, sf_dir, "customer")),
                             _role_edges(spark, sf_dir))


@query
def effective_privileges(spark, sf_dir):
    relations = derive.relation_catalogue(load(spark, sf_dir, "part"))
    return privileges.relation_privileges(relations, SHIPPED)


@query
def privilege_lists(spark, sf_dir):
    return privileges.privilege_lists(effective_privileges(spark, sf_dir))


@query
def object_privileges(spark, sf_dir):
    return privileges.object_privileges(derive.database_objects(load(spark, sf_dir, "part")), SHIPPED)


@query
def default_deny_probe(spark, sf_dir):
    relations = derive.relation_catalogue(load(spark, sf_dir, "part"))
    return privileges.default_deny_probe(relations, SHIPPED)


@query
def policy_lint(spark, sf_dir):
    supplier = load(spark, sf_dir, "supplier")
    return lint.policy_lint(
        derive.declared_roles(supplier, load(spark, sf_dir, "nation")),
        derive.declared_groups(supplier), derive.declared_resources(load(spark, sf_dir, "part")),
        derive.declared_grants(load(spark, sf_dir, "lineitem")))


@query
def declared_exposure(spark, sf_dir):
    """Declared resources with their class, and what each grant leaves open of them."""
    found = lint.grant_exposure(derive.declared_resources(load(spark, sf_dir, "part")),
                                derive.declared_grants(load(spark, sf_dir, "lineitem")))
    return found.select("resource", "grant_id", "classification",
                        F.array_join("sensitive_columns", ",").alias("sensitive_columns"),
                        F.array_join("open_columns", ",").alias("open_columns"), "allow_unmasked")


@query
def role_name_collisions(spark, sf_dir):
    return lint.role_name_collisions(derive.role_spellings(load(spark, sf_dir, "customer")))


@query
def duplicate_grants(spark, sf_dir):
    return lint.duplicate_catalog_grants(derive.catalog_grants(load(spark, sf_dir, "orders")))


@query
def conflicting_masks(spark, sf_dir):
    return lint.conflicting_masks(derive.declared_grants(load(spark, sf_dir, "lineitem")))


# --- drift, audit, lineage -----------------------------------------------------------------

@query
def drift_diff(spark, sf_dir):
    return drift.drift(*derive.directory_state(load(spark, sf_dir, "customer")))


@query
def drift_summary(spark, sf_dir):
    return drift.drift_summary(drift_diff(spark, sf_dir))


@query
def audit_timeline(spark, sf_dir):
    decisions = access.decide_deny(_requests(spark, sf_dir))
    return audit.timeline(
        audit.decision_log(decisions),
        audit.change_log(cdc.normalize(derive.order_changes(load(spark, sf_dir, "orders"))),
                         "orders", "order_id"),
        audit.query_log(_clicks(spark, sf_dir)))


@query
def recent_denials(spark, sf_dir):
    return audit.recent_denials(access.decide_deny(_requests(spark, sf_dir)))


@query
def lineage_reach(spark, sf_dir):
    return graph.closure(derive.lineage_edges(load(spark, sf_dir, "events")), "src", "dst")
