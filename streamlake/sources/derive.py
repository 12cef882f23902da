"""Feeds derived from the star-schema tables, one row-wise rule each.

They stand in for the topics, request logs and declarations a deployment would supply, keep
the size of the table they come from, and need no shuffle of their own unless noted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


# --- clickstream ---------------------------------------------------------------------------

def clickstream(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "user_id", F.col("event_type").alias("action"),
        F.col("ts").alias("timestamp"),
        F.floor("value").cast("int").alias("duration_ms"))


def click_records(events: DataFrame) -> DataFrame:
    """Wire shape of the clickstream topic: textual ids and a page."""
    return clickstream(events.withColumn("k", F.get_json_object("props", "$.k"))).select(
        F.concat(F.lit("evt_"), "event_id").alias("event_id"),
        F.concat(F.lit("user_"), "user_id").alias("user_id"),
        F.concat(F.lit("/"), "action").alias("page"),
        "action", "timestamp", "duration_ms")


# --- operational tables and their change logs ----------------------------------------------

def shop_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("total_amount"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))


def shop_customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return (customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
                    email_of(F.col("c_name")).alias("email"), F.col("n_name").alias("city"),
                    F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at")))


CLICK_MONTH_START = 1704067200  # 2024-01-01 00:00:00 UTC, where the clickstream begins
CLICK_MONTH_SECONDS = 30 * 86400


def order_placements(orders: DataFrame) -> DataFrame:
    """Order placements at the clickstream's time: every order placed once, at a moment of the
    clickstream's month spread by its key, by the customer who is the clickstream's user of that id."""
    offset = (F.col("o_orderkey") * 7919) % CLICK_MONTH_SECONDS
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit("user_"), F.col("o_custkey")).alias("user_id"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("total_amount"),
        F.timestamp_seconds(F.lit(CLICK_MONTH_START) + offset).cast("timestamp_ntz").alias("placed_at"))


def email_of(name: Column) -> Column:
    return F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@example.com"))


def order_changes(orders: DataFrame) -> DataFrame:
    """Change log of the orders table: every order is read once, every third is updated a day
    later, every tenth is deleted a day after that. Envelope columns, one row per change."""
    def image(status: Column, at: Column) -> Column:
        return F.struct(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.col("o_totalprice").cast("decimal(10,2)").cast("string").alias("total_amount"),
            status.alias("status"), F.date_format(at, ISO_MICROS).alias("updated_at"))

    first = F.col("o_orderdate")
    second = first + F.expr("INTERVAL 1 DAY")
    third = first + F.expr("INTERVAL 2 DAYS")
    initial, changed = image(F.col("o_orderstatus"), first), image(F.lit("X"), second)
    updated = F.col("o_orderkey") % 3 == 0
    return _change_rows(orders, [
        (F.lit(True), "r", None, initial, first),
        (updated, "u", initial, changed, second),
        (F.col("o_orderkey") % 10 == 0, "d", F.when(updated, changed).otherwise(initial), None,
         third)])


def customer_changes(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Change log of the customers table: one read each; every fourth moves, every ninth goes."""
    def image(city: Column) -> Column:
        return F.struct(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
            email_of(F.col("c_name")).alias("email"), city.alias("city"),
            F.lit("2024-01-01T00:00:00.000000Z").alias("created_at"))

    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    initial, changed = image(F.col("n_name")), image(F.lit("MOVED"))
    moved = F.col("c_custkey") % 4 == 0
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return _change_rows(rows, [
        (F.lit(True), "r", None, initial, start),
        (moved, "u", initial, changed, start + F.expr("INTERVAL 1 DAY")),
        (F.col("c_custkey") % 9 == 0, "d", F.when(moved, changed).otherwise(initial), None,
         start + F.expr("INTERVAL 2 DAYS"))])


def _change_rows(rows: DataFrame, changes) -> DataFrame:
    envelopes = []
    for seq, (applies, op, before, after, at) in enumerate(changes):
        record = F.struct(
            (F.lit(None) if before is None else before).alias("before"),
            (F.lit(None) if after is None else after).alias("after"),
            F.lit(op).alias("op"),
            F.unix_millis(at.cast("timestamp")).alias("ts_ms"),
            F.lit(seq).cast("bigint").alias("seq"))
        envelopes.append(F.when(applies, record))
    return _explode(rows, envelopes)


def _explode(rows: DataFrame, structs: list[Column]) -> DataFrame:
    """One output row per struct that is not null."""
    return rows.select(F.explode(F.array(*structs)).alias("c")).where("c IS NOT NULL").select("c.*")


# --- access requests -----------------------------------------------------------------------

# One query-engine operation per event, in turn.
REQUEST_OPERATIONS = [
    "SelectFromColumns", "InsertIntoTable", "UpdateTableColumns", "DeleteFromTable", "DropTable",
    "AddColumn", "ExecuteQuery", "AccessCatalog", "ShowSchemas", "FilterCatalogs", "ShowTables",
    "FilterSchemas", "ShowFunctions", "ShowColumns", "ShowCreateTable", "FilterTables",
    "SetCatalogSessionProperty"]
REQUEST_TABLES = ["customers", "orders", "events_enriched", "customers_v2"]
TOPIC_OPERATIONS = ["Read", "Write", "Describe", "Delete", "Alter", "AlterConfigs", "Create"]


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def request_groups(plural: bool) -> Column:
    """Group claim of a user: none, one, or two groups; no claim at all for every 11th user."""
    names = [n + "s" if plural else n for n in ("analyst", "engineer", "admin")]
    a, e, m = (F.lit(n) for n in names)
    sets = F.array(F.array().cast("array<string>"), F.array(a), F.array(e), F.array(m),
                   F.array(a, e), F.array(F.lit("nobody")))
    return F.when(F.col("user_id") % 11 != 0,
                  F.element_at(sets, (F.col("user_id") % 6 + 1).cast("int")))


def access_requests(events: DataFrame, plural: bool) -> DataFrame:
    """Query-engine request log: who asks for which operation on which resource."""
    e = F.col("event_id")
    catalog = F.when(e % 5 == 0, "system").when(e % 19 == 0, "evil").otherwise("iceberg")
    schema = F.lit("lake")
    table = pick(REQUEST_TABLES, F.floor(e / 7) % 4)
    operation = pick(REQUEST_OPERATIONS, e % 17)
    on_table = operation.isin("InsertIntoTable", "UpdateTableColumns", "DeleteFromTable",
                              "DropTable", "AddColumn", "ShowColumns", "ShowCreateTable",
                              "FilterTables")
    on_column = operation == "SelectFromColumns"
    resource = F.struct(
        F.when(on_table | (on_column & (e % 2 == 0)), F.struct(
            catalog.alias("catalogName"), schema.alias("schemaName"),
            table.alias("tableName"))).alias("table"),
        F.when(on_column & (e % 2 == 1), F.struct(
            catalog.alias("catalogName"), schema.alias("schemaName"),
            table.alias("tableName"), F.lit("email").alias("columnName"))).alias("column"),
        F.when(operation.isin("ShowTables", "FilterSchemas", "ShowFunctions"), F.struct(
            catalog.alias("catalogName"), schema.alias("schemaName"))).alias("schema"),
        F.when(operation.isin("AccessCatalog", "ShowSchemas", "FilterCatalogs"), F.struct(
            catalog.alias("name"))).alias("catalog"),
        F.when(operation == "SetCatalogSessionProperty", F.struct(
            catalog.alias("catalogName"), F.lit("p").alias("propertyName")))
        .alias("catalogSessionProperty"))
    user = F.when(F.col("user_id") % 40 == 7, "analyst") \
            .otherwise(F.concat(F.lit("user_"), "user_id"))
    return events.select(
        e.alias("request_id"), F.col("ts"),
        F.struct(F.struct(user.alias("user"), request_groups(plural).alias("groups"))
                 .alias("identity")).alias("context"),
        F.struct(operation.alias("operation"), resource.alias("resource")).alias("action"))


POLICY_EVERY = 50  # every 50th event is also a change of one table's policy


def policy_changes(events: DataFrame) -> DataFrame:
    """Policy log: from its time on, a change says whether a table holds personal data; tables are
    changed in turn, and every third change lifts the protection."""
    e = F.col("event_id")
    turn = F.floor(e / POLICY_EVERY)
    return events.where(e % POLICY_EVERY == 0).select(
        e.alias("version"), F.col("ts"), pick(REQUEST_TABLES, turn % 4).alias("table_name"),
        (turn % 3 != 0).alias("protected"))


def topic_requests(events: DataFrame) -> DataFrame:
    """Broker request log; identity by principal name, principal groups or request groups."""
    e, u = F.col("event_id"), F.col("user_id")
    role = pick(["analyst", "engineer", "admin", "guest"], u % 4)
    name = F.when(u % 5 == 0, F.concat(F.lit("User:"), role)) \
            .when(u % 5 == 1, F.concat(F.lit("User:svc-"), role)) \
            .when(u % 5 == 2, role).otherwise(F.concat(F.lit("User:u"), u))
    return events.select(
        e.alias("request_id"),
        F.struct(
            F.struct(name.alias("name"), F.when(u % 5 == 3, F.array(role)).alias("groups"))
            .alias("principal"),
            F.when(u % 5 == 4, F.array(role)).alias("groups")).alias("requestContext"),
        F.struct(pick(TOPIC_OPERATIONS, e % 7).alias("operation"),
                 pick(["topic", "group", "cluster"], e % 3).alias("resourceType"))
        .alias("action"))


# --- declarations at table size ------------------------------------------------------------

def role_edges(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Role inheritance: customer role > segment role > nation role > region role > engineers >
    analysts. The segment roles are made distinct (one small shuffle after a local combine)."""
    nation_role = F.concat(F.lit("n-"), "c_nationkey")
    segment_role = F.concat(F.lit("s-"), "c_nationkey", F.lit("-"), F.lower("c_mktsegment"))
    segments = customer.select(segment_role.alias("role"), nation_role.alias("parent")).distinct()
    return (customer.select(F.concat(F.lit("c-"), "c_custkey").alias("role"),
                            segment_role.alias("parent"))
            .unionByName(segments)
            .unionByName(nation.select(F.concat(F.lit("n-"), "n_nationkey").alias("role"),
                                       F.concat(F.lit("r-"), "n_regionkey").alias("parent")))
            .unionByName(nation.select(F.concat(F.lit("r-"), "n_regionkey").alias("role"),
                                       F.lit("engineers").alias("parent")).distinct())
            .unionByName(nation.where("n_nationkey = 0").select(
                F.explode(F.array(
                    F.struct(F.lit("engineers").alias("role"), F.lit("analysts").alias("parent")),
                    F.struct(F.lit("admins").alias("role"), F.lit("engineers").alias("parent"))))
                .alias("x")).select("x.*")))


def team_groups(customer: DataFrame) -> DataFrame:
    """One group per customer; every seventh also holds ``admins``."""
    role = F.concat(F.lit("c-"), "c_custkey")
    return customer.select(
        F.concat(F.lit("team-"), "c_custkey").alias("name"),
        F.when(F.col("c_custkey") % 7 == 0, F.array(role, F.lit("admins")))
        .otherwise(F.array(role)).alias("roles"))


def declared_roles(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Roles of a faulty declaration: every 29th supplier role inherits an unknown role, every
    25th sits on a two-role cycle."""
    k = F.col("s_suppkey")
    role = F.concat(F.lit("s-"), k)
    twin = F.concat(F.lit("twin-"), k)
    suppliers = supplier.select(F.explode(F.when(k % 25 == 0, F.array(
        F.struct(role.alias("name"), F.array(twin).alias("includes")),
        F.struct(twin.alias("name"), F.array(role).alias("includes"))))
        .otherwise(F.array(F.struct(role.alias("name"), F.array(
            F.when(k % 29 == 0, F.concat(F.lit("ghost-"), k))
            .otherwise(F.concat(F.lit("n-"), "s_nationkey"))).alias("includes")))))
        .alias("r")).select("r.*")
    return suppliers.unionByName(nation.select(
        F.concat(F.lit("n-"), "n_nationkey").alias("name"),
        F.array().cast("array<string>").alias("includes")))


def declared_groups(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        F.concat(F.lit("group-"), k).alias("name"),
        F.array(F.concat(F.when(k % 31 == 0, "lost-").otherwise("s-"), k)).alias("roles"))


def declared_resources(part: DataFrame) -> DataFrame:
    size = F.col("p_size")
    return part.select(
        F.concat(F.lit("lake.part_"), "p_partkey").alias("resource"),
        F.when(size % 3 == 0, "pii").when(size % 3 == 1, "internal").otherwise("public")
        .alias("classification"),
        F.when(size % 9 == 0, F.array().cast("array<string>"))
        .when(size % 2 == 0, F.array(F.lit("email")))
        .otherwise(F.array(F.lit("email"), F.lit("ssn"))).alias("sensitive_columns"))


# Filter texts used in turn: the first four are well-formed, the others are not.
FILTER_TEXTS = [
    "branch = 'north'", "floor IN (3, 5, 8)", "signed_by = current_user", "weight >= 2.5 AND state <> 'void'",
    "branch = 'north') OR (weight > 0", "floor IN (SELECT 3)", "weight > 1 AND floor = 2 OR floor = 3",
    "state = 'void"]


def declared_grants(lineitem: DataFrame) -> DataFrame:
    """One grant per line item: a supplier role on a part resource."""
    o, n, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    hashed = F.create_map(F.lit("email"), F.lit("hash"))
    both = F.create_map(F.lit("email"), F.lit("partial"), F.lit("ssn"), F.lit("null"))
    return lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("grant_id"),
        F.concat(F.lit("lake.part_"), "l_partkey").alias("resource"),
        F.array(F.concat(F.when(o % 101 == 0, "ghost-").otherwise("s-"), s)).alias("roles"),
        F.when(n % 2 == 1, F.array(F.lit("select"))).otherwise(
            F.array(F.lit("insert"), F.lit("update"))).alias("privileges"),
        F.when(n % 3 == 0, hashed).when(n % 3 == 1, both).alias("column_mask"),
        F.when(o % 9 != 0, pick(FILTER_TEXTS, o % 8)).alias("row_filter"),
        (F.col("l_returnflag") == "A").alias("allow_unmasked"))


def catalog_grants(orders: DataFrame) -> DataFrame:
    """One catalog grant per order: a role list on the customer's catalog."""
    status = F.lower("o_orderstatus")
    return orders.select(
        F.concat(F.lit("cat_"), "o_custkey").alias("catalog"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("analysts"), status))
        .otherwise(F.array(status, F.lit("analysts"))).alias("roles"))


def role_spellings(customer: DataFrame) -> DataFrame:
    """Role names as different teams spell them; neighbours may fold to one name."""
    k = F.col("c_custkey")
    half = F.floor(k / 2)
    return customer.select(
        F.when(k % 6 == 0, F.concat(F.lit("Team-"), half))
        .when(k % 6 == 1, F.concat(F.lit("team_"), half))
        .otherwise(F.concat(F.lit("team-"), k, F.lit("-x"))).alias("name"))


def directory_state(customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(desired, actual) identity directory as rows ``(object, name, roles)``: the actual side
    misses some roles and groups, has some of its own, and differs in some role lists."""
    k = F.col("c_custkey")
    role = F.concat(F.lit("c-"), k)
    none = F.array().cast("array<string>")

    def rows(present: list[tuple]) -> DataFrame:
        entries = [F.when(cond, F.struct(F.lit(obj).alias("object"), name.alias("name"),
                                         roles.alias("roles"))) for cond, obj, name, roles in present]
        return _explode(customer, entries)

    team = F.concat(F.lit("team-"), k)
    want = F.array(role, F.lit("viewers"))
    have = F.when(k % 19 == 0, F.array(role)).otherwise(F.array(F.lit("viewers"), role))
    desired = rows([(F.lit(True), "role", role, none), (F.lit(True), "group", team, want)])
    actual = rows([
        (k % 11 != 0, "role", role, none),
        (k % 17 == 0, "role", F.concat(F.lit("manual-"), k), none),
        (k % 13 != 0, "group", team, have),
        (k % 23 == 0, "group", F.concat(F.lit("adhoc-"), k), none)])
    return desired, actual


def relation_catalogue(part: DataFrame) -> DataFrame:
    """Relations of a database, one per part, schema by brand. ``is_new`` relations were created
    after the grants; ``is_pii`` ones are withheld from analysts."""
    return part.select(
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("schema_name"),
        F.concat(F.lit("part_"), "p_partkey").alias("table_name"),
        (F.col("p_partkey") % 5 == 0).alias("is_new"), (F.col("p_size") > 40).alias("is_pii"))


def database_objects(part: DataFrame) -> DataFrame:
    """One object per part, of the four kinds in turn."""
    k = F.col("p_partkey")
    kind = pick(["table", "sequence", "schema", "database"], k % 4)
    return part.select(kind.alias("kind"), F.concat(kind, F.lit("_"), k).alias("name"),
                       (k % 5 == 0).alias("is_new"), (F.col("p_size") > 40).alias("is_pii"))


def lineage_edges(events: DataFrame) -> DataFrame:
    """Topic per user > job per action > table > dashboard."""
    action = F.col("event_type")
    pairs = events.select("user_id", "event_type").distinct()
    return pairs.select(F.explode(F.array(
        F.struct(F.concat(F.lit("topic/user_"), "user_id").alias("src"),
                 F.concat(F.lit("job/tumble_"), action).alias("dst")),
        F.struct(F.concat(F.lit("job/tumble_"), action).alias("src"),
                 F.concat(F.lit("table/"), action, F.lit("_minutes")).alias("dst")),
        F.struct(F.concat(F.lit("table/"), action, F.lit("_minutes")).alias("src"),
                 F.lit("dashboard/activity").alias("dst")))).alias("e")).select("e.*")
