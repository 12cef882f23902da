"""Access decisions over request logs, and governed views of tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from streamlake.functions.masks import apply_masks
from streamlake.operators import asof
from streamlake.functions.rowfilter import to_column
from streamlake.policy import TEXT, TEXTS, Policy, small_frame

# Operations the deny rules treat as writes.
WRITE_OPERATIONS = [
    "InsertIntoTable", "CreateTable", "DropTable", "RenameTable", "AlterTable", "CreateSchema",
    "DropSchema", "RenameSchema", "CreateView", "DropView", "RenameView", "DeleteFromTable",
    "TruncateTable", "AddColumn", "DropColumn", "RenameColumn", "SetTableProperties",
    "ExecuteProcedure"]

# Topic operations withheld from analysts.
RESTRICTED_TOPIC_OPERATIONS = [
    "Write", "Delete", "Alter", "AlterConfigs", "ClusterAction", "Create"]

# Table operation of each privilege.
PRIVILEGE_OPERATIONS = {
    "select": "SelectFromColumns", "insert": "InsertIntoTable",
    "update": "UpdateTableColumns", "delete": "DeleteFromTable"}

# Where a catalog-level operation names its catalog.
CATALOG_OPERATION_SHAPES = {
    "ExecuteQuery": "none", "AccessCatalog": "catalog", "ShowSchemas": "catalog",
    "FilterCatalogs": "catalog", "ShowTables": "schema", "FilterSchemas": "schema",
    "ShowFunctions": "schema", "ShowColumns": "table", "ShowCreateTable": "table",
    "FilterTables": "table", "SetCatalogSessionProperty": "catalogSessionProperty"}

# Topic access by account; "All" stands for every operation.
TOPIC_ACLS = [
    ("admin", "topic", "All"), ("admin", "group", "All"), ("admin", "cluster", "All"),
    ("engineer", "topic", "Read"), ("engineer", "topic", "Write"), ("engineer", "topic", "Describe"),
    ("engineer", "group", "Read"),
    ("analyst", "topic", "Read"), ("analyst", "topic", "Describe"), ("analyst", "group", "Read")]

# Application role of each login group, and the role of everybody else.
APP_ROLES = {"admins": "Admin", "engineers": "Alpha", "analysts": "Gamma"}
DEFAULT_APP_ROLE = "Gamma"

_IDENTITY = "context.identity."
_RESOURCE = "action.resource."


def yes(condition: Column) -> Column:
    """A condition on a missing field does not hold."""
    return F.coalesce(condition, F.lit(False))


def has_group(groups: Column, name: str) -> Column:
    return yes(F.array_contains(groups, name))


# --- deny-override decisions ---------------------------------------------------------------

def decide_deny(requests: DataFrame, write_operations: list[str] | None = None,
                plural_groups: bool = False, protected: Column | None = None) -> DataFrame:
    """Query-engine requests: allowed unless a deny rule holds. A row-wise expression, no shuffle.

    ``write_operations`` may extend the shipped list, which has no ``UpdateTableColumns``;
    ``plural_groups`` also recognises ``analysts``, ``engineers`` and ``admins``; ``protected`` says
    which requests touch personal data (by default: those on the ``customers`` table).
    """
    user, groups = F.col(_IDENTITY + "user"), F.col(_IDENTITY + "groups")

    def is_a(name: str) -> Column:
        member = has_group(groups, name) | yes(user == name)
        return member | has_group(groups, name + "s") if plural_groups else member

    analyst, engineer, admin = is_a("analyst"), is_a("engineer"), is_a("admin")
    customers = yes(protected) if protected is not None else (
        yes(F.col(_RESOURCE + "table.tableName") == "customers")
        | yes(F.col(_RESOURCE + "column.tableName") == "customers"))
    system = (yes(F.col(_RESOURCE + "table.catalogName") == "system")
              | yes(F.col(_RESOURCE + "catalog.name") == "system")
              | yes(F.col(_RESOURCE + "schema.catalogName") == "system")
              | yes(F.col(_RESOURCE + "column.catalogName") == "system"))
    write = yes(F.col("action.operation").isin(write_operations or WRITE_OPERATIONS))
    rules = requests.withColumns({
        "deny_analyst_pii": analyst & customers,
        "deny_analyst_write": analyst & write,
        "deny_engineer_system": engineer & system & write,
        "deny_unknown_pii": ~(admin | engineer | analyst) & customers})
    return rules.withColumn("allowed", ~(
        F.col("deny_analyst_pii") | F.col("deny_analyst_write")
        | F.col("deny_engineer_system") | F.col("deny_unknown_pii")))


def named_table(requests: DataFrame) -> Column:
    return F.coalesce(F.col(_RESOURCE + "table.tableName"), F.col(_RESOURCE + "column.tableName"))


def decide_in_force(requests: DataFrame, changes: DataFrame, range_rows: int = asof.RANGE_ROWS) -> DataFrame:
    """Deny-override decisions by the policy in force when each request was made.

    ``changes`` is a log of ``version, ts, table_name, protected``: from its time on, a change decides
    whether requests on its table touch personal data. A table without a change before a request keeps
    the shipped rule (only ``customers`` is protected). Adds ``table_name``, the struct ``policy`` (the
    change in force, or null) and ``protected``; the decision columns are those of ``decide_deny``.
    """
    named = requests.withColumn("table_name", named_table(requests))
    joined = asof.last_before(named, changes.select("version", "ts", "table_name", "protected"),
                              "table_name", "ts", "ts", "version", "policy", range_rows)
    protected = F.coalesce(F.col("policy.protected"), F.col("table_name") == "customers", F.lit(False))
    return decide_deny(joined.withColumn("protected", protected), protected=F.col("protected"))


def decide_topic(requests: DataFrame, account_prefix: str = "svc-") -> DataFrame:
    """Broker requests: allowed unless an analyst asks for a restricted operation."""
    name = F.col("requestContext.principal.name")
    analyst = (yes(name.isin("User:analyst", f"User:{account_prefix}analyst", "analyst"))
               | has_group(F.col("requestContext.principal.groups"), "analyst")
               | has_group(F.col("requestContext.groups"), "analyst"))
    restricted = yes(F.col("action.operation").isin(RESTRICTED_TOPIC_OPERATIONS))
    return requests.withColumn("allowed", ~(analyst & restricted))


# --- allow-by-grant decisions --------------------------------------------------------------

def allow_by_permission(requests: DataFrame, permissions: DataFrame, keys: dict[str, Column],
                        holds) -> DataFrame:
    """Add ``allowed``: does the row of ``permissions`` with the request's keys let it pass?

    ``permissions`` is declared, one row per combination of keys, and small: its size is known to
    the planner, so the log is read once and not shuffled while that fits a broadcast. Beyond it
    the left join sorts and merges, and Spark splits the keys that hold most of the log.
    """
    declared = permissions.select(*[F.col(c).alias(f"_{c}") for c in permissions.columns])
    matched = reduce(and_, [value.eqNullSafe(F.col(f"_{name}")) for name, value in keys.items()])
    return (requests.join(declared, matched, "left")
            .withColumn("allowed", yes(holds(lambda name: F.col(f"_{name}"))))
            .drop(*declared.columns))


def flat_requests(requests: DataFrame) -> DataFrame:
    """Requests with user, groups, operation and the names of the resource as plain columns."""
    table = F.col(_RESOURCE + "table")
    column = F.col(_RESOURCE + "column")
    return requests.withColumns({
        "user": F.col(_IDENTITY + "user"),
        "groups": F.coalesce(F.col(_IDENTITY + "groups"), F.array().cast("array<string>")),
        "operation": F.col("action.operation"),
        "catalog_name": F.coalesce(table.catalogName, column.catalogName),
        "schema_name": F.coalesce(table.schemaName, column.schemaName,
                                  F.col(_RESOURCE + "schema.schemaName")),
        "table_name": F.coalesce(table.tableName, column.tableName)})


def table_permissions(spark: SparkSession, policy: Policy) -> DataFrame:
    """One row per ``(operation, schema_name, table_name)`` with the ``holders`` of the roles that
    are granted it."""
    held: dict[tuple, set[str]] = {}
    for grant in policy.grants:
        schema, _, table = grant.resource.rpartition(".")
        for privilege in grant.privileges:
            key = (PRIVILEGE_OPERATIONS[privilege], schema, table)
            held.setdefault(key, set()).update(*map(policy.holders_of, grant.roles))
    rows = [(*key, sorted(holders)) for key, holders in sorted(held.items())]
    return small_frame(spark, rows, operation=TEXT, schema_name=TEXT, table_name=TEXT, holders=TEXTS)


def catalog_permissions(spark: SparkSession, policy: Policy) -> DataFrame:
    """One row per ``(operation, catalog)`` with the ``holders``; an operation that names no
    catalog has a row without one, held by whoever holds it on any catalog."""
    held: dict[tuple, set[str]] = {}
    for catalog, roles, operations in policy.catalog_grants:
        for operation in operations:
            named = None if CATALOG_OPERATION_SHAPES.get(operation) == "none" else catalog
            held.setdefault((operation, named), set()).update(*map(policy.holders_of, roles))
    rows = [(op, catalog is not None, catalog, sorted(h))
            for (op, catalog), h in sorted(held.items(), key=str)]
    return small_frame(spark, rows, operation=TEXT, named=pa.bool_(), catalog=TEXT, holders=TEXTS)


def decide_allow(requests: DataFrame, permissions: DataFrame, catalog: str = "iceberg") -> DataFrame:
    """Query-engine requests, denied by default: a group of the caller must hold a role granted
    the operation on the table, in the deployed catalog. Only table resources match."""
    flat = flat_requests(requests).withColumns({
        "catalog_name": F.col(_RESOURCE + "table.catalogName"),
        "schema_name": F.col(_RESOURCE + "table.schemaName"),
        "table_name": F.col(_RESOURCE + "table.tableName")})
    keys = {k: F.col(k) for k in ("operation", "schema_name", "table_name")}
    return allow_by_permission(flat, permissions, keys, lambda of: (
        (F.col("catalog_name") == catalog) & F.arrays_overlap("groups", of("holders"))))


def decide_catalog(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """Catalog-level requests, denied by default, by ``catalog_permissions``."""
    by_shape = {
        "catalog": F.col(_RESOURCE + "catalog.name"),
        "schema": F.col(_RESOURCE + "schema.catalogName"),
        "table": F.col(_RESOURCE + "table.catalogName"),
        "catalogSessionProperty": F.col(_RESOURCE + "catalogSessionProperty.catalogName")}
    operation = F.col("operation")
    named = F.lit(None).cast("string")
    for shape, path in by_shape.items():
        operations = [o for o, s in CATALOG_OPERATION_SHAPES.items() if s == shape]
        named = F.when(operation.isin(operations), path).otherwise(named)
    bare = operation.isin([o for o, s in CATALOG_OPERATION_SHAPES.items() if s == "none"])
    flat = flat_requests(requests).withColumn("catalog", named)
    keys = {"operation": operation, "named": ~bare, "catalog": F.col("catalog")}
    return allow_by_permission(flat, permissions, keys,
                               lambda of: F.arrays_overlap("groups", of("holders")))


def visible_objects(listings: DataFrame, permissions: DataFrame) -> DataFrame:
    """Browse filter: of the catalogs, schemas and tables listed to callers, those they may see.
    Nothing is reported for the rest."""
    asked = listings.where(F.col("action.operation").isin(
        "FilterCatalogs", "FilterSchemas", "FilterTables"))
    return decide_catalog(asked, permissions).where("allowed").drop("allowed")


def topic_acls(spark: SparkSession, acls=TOPIC_ACLS) -> DataFrame:
    """One row per ``(account, resource_type)`` with its ``operations``."""
    held: dict[tuple, set[str]] = {}
    for account, resource_type, operation in acls:
        held.setdefault((account, resource_type), set()).add(operation)
    rows = [(*key, sorted(operations)) for key, operations in sorted(held.items())]
    return small_frame(spark, rows, account=TEXT, resource_type=TEXT, operations=TEXTS)


def decide_topic_acl(requests: DataFrame, acls: DataFrame, account_prefix: str = "svc-") -> DataFrame:
    """Broker requests by access-control list, denied by default."""
    account = F.regexp_replace("requestContext.principal.name", f"^(User:)?({account_prefix})?", "")
    flat = requests.withColumns({
        "account": account, "resource_type": F.col("action.resourceType"),
        "operation": F.col("action.operation")})
    keys = {"account": F.col("account"), "resource_type": F.col("resource_type")}
    return allow_by_permission(flat, acls, keys, lambda of: F.arrays_overlap(
        F.array("operation", F.lit("All")), of("operations")))


def table_rules(spark: SparkSession, policy: Policy) -> DataFrame:
    """One row per ``(schema_name, table_name)`` with its ``rules (role, row_filter, column, mask)``: what
    the grants of a role impose on whoever holds this very role."""
    held: dict[tuple, set[tuple]] = {}
    for grant in policy.grants:
        schema, _, table = grant.resource.rpartition(".")
        rules = held.setdefault((schema, table), set())
        for role in grant.roles:
            if grant.row_filter:
                rules.add((role, grant.row_filter, None, None))
            rules.update((role, None, column, kind) for column, kind in grant.column_mask.items())
    names = ("role", "row_filter", "column", "mask")
    rows = [(*key, [dict(zip(names, rule)) for rule in sorted(rules, key=str)])
            for key, rules in sorted(held.items())]
    return small_frame(spark, rows, schema_name=TEXT, table_name=TEXT, rules=pa.list_(
        pa.struct([(name, TEXT) for name in names])))


def governing_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests on tables with the ``row_filters`` and ``masks`` (``column:kind``) that apply to the
    caller, both distinct and in order; all filters apply, and two masks for one column are a conflict
    that the list shows. Joined like the decisions: the log is read once."""
    flat = flat_requests(requests)
    declared = rules.select(F.col("schema_name").alias("_schema"), F.col("table_name").alias("_table"),
                            "rules")
    own = F.filter(F.coalesce("rules", F.array().cast(rules.schema["rules"].dataType)),
                   lambda r: F.array_contains("groups", r["role"]))

    def listed(value) -> Column:
        return F.array_sort(F.array_distinct(F.array_compact(F.transform("_own", value))))

    return (flat.join(declared, (F.col("schema_name") == F.col("_schema"))
                      & (F.col("table_name") == F.col("_table")), "left")
            .withColumn("_own", own)
            .withColumn("row_filters", listed(lambda r: r["row_filter"]))
            .withColumn("masks", listed(lambda r: F.concat(r["column"], F.lit(":"), r["mask"])))
            .drop("_schema", "_table", "_own", "rules"))


def app_roles(users: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Add ``app_role`` by ``group_name``; ``roles`` is ``(group_name, app_role)``, by default
    the fixed mapping."""
    if roles is None:
        roles = small_frame(users.sparkSession, list(APP_ROLES.items()),
                            group_name=TEXT, app_role=TEXT)
    return users.join(roles, "group_name", "left").withColumn(
        "app_role", F.coalesce("app_role", F.lit(DEFAULT_APP_ROLE)))


# --- governed views ------------------------------------------------------------------------

class AccessDenied(PermissionError):
    pass


class ConflictingMask(ValueError):
    pass


def secure_view(rows: DataFrame, policy: Policy, resource: str, groups: list[str],
                user: str) -> DataFrame:
    """The table as the caller may read it.

    Select must be granted to a role one of the groups holds. Every row filter of the caller's
    own roles applies; so does every mask of them. Filters see the raw values and reach the
    scan. Filters and masks of a role do not pass on to the roles that include it.
    """
    grants = [g for g in policy.grants if g.resource == resource]
    if not any(policy.holders_of(r) & set(groups)
               for g in grants if "select" in g.privileges for r in g.roles):
        raise AccessDenied(f"{user} may not read {resource}")
    own = [g for g in grants if set(g.roles) & set(groups)]
    for text in sorted({g.row_filter for g in own if g.row_filter}):
        rows = rows.where(to_column(text, user))
    masks: dict[str, str] = {}
    for grant in own:
        for column, kind in grant.column_mask.items():
            if masks.setdefault(column, kind) != kind:
                raise ConflictingMask(f"{resource}.{column}: {masks[column]} and {kind}")
    return apply_masks(rows, masks)


BITS_PER_WORD = 62  # filters of one bit-map word


def visible_by_role(rows: DataFrame, policy: Policy, resource: str) -> DataFrame:
    """For every role of the policy at once: ``allowed`` (select is granted to a role it holds),
    ``visible_rows`` (rows all row filters of its own grants leave, 0 if not allowed) and
    ``open_columns`` (the columns its own grants do not mask, by name, comma-joined).

    Every distinct filter is evaluated once per row, as one bit of a bit map (words of 62 bits);
    rows are counted per distinct bit map, combined ahead of the shuffle, so what is shuffled is one
    row per bit map and task. A role is the mask of its filters' bits: its rows are the counts of the
    bit maps that hold all its bits. A filter naming ``current_user`` is read with the role's name as
    the user, so it is one filter per role. A role without filters sees every row.
    """
    grants = [g for g in policy.grants if g.resource == resource]
    subjects = sorted(policy.roles)
    filters: dict[tuple[str, str | None], int] = {}
    own: dict[str, list[int]] = {}
    for role in subjects:
        bits = []
        for grant in grants:
            if role in grant.roles and grant.row_filter:
                user = role if "current_user" in grant.row_filter.lower() else None
                bits.append(filters.setdefault((grant.row_filter, user), len(filters)))
        own[role] = sorted(set(bits))
    words = max(1, -(-len(filters) // BITS_PER_WORD))

    def word(j: int) -> Column:
        terms = [F.when(yes(to_column(text, user or "")), F.lit(1 << (i % BITS_PER_WORD)))
                 .otherwise(F.lit(0)) for (text, user), i in filters.items() if i // BITS_PER_WORD == j]
        return reduce(lambda a, b: a + b, terms, F.lit(0).cast("long")).cast("long")

    counted = (rows.select(*[word(j).alias(f"w{j}") for j in range(words)])
               .groupBy(*[f"w{j}" for j in range(words)]).agg(F.count("*").alias("n")))
    masks = F.array(*[F.struct(F.lit(role).alias("role"), *[
        F.lit(sum(1 << (i % BITS_PER_WORD) for i in own[role] if i // BITS_PER_WORD == j))
        .cast("long").alias(f"m{j}") for j in range(words)]) for role in subjects])
    holds = F.filter(masks, lambda r: reduce(and_, [
        (F.col(f"w{j}").bitwiseAND(r[f"m{j}"]) == r[f"m{j}"]) for j in range(words)]))
    seen = (counted.select(F.explode(holds).alias("r"), "n")
            .groupBy(F.col("r.role").alias("role")).agg(F.sum("n").alias("seen")))
    declared = []
    for role in subjects:
        allowed = any("select" in g.privileges and role in policy.holders_of(r) for g in grants for r in g.roles)
        masked = {c for g in grants if role in g.roles for c in g.column_mask}
        declared.append((role, allowed, ",".join(sorted(c for c in rows.columns if c not in masked))))
    roles = small_frame(rows.sparkSession, declared, role=TEXT, allowed=pa.bool_(), open_columns=TEXT)
    return roles.join(seen, "role", "left").select(
        "role", "allowed",
        F.when(F.col("allowed"), F.coalesce("seen", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("visible_rows"),
        "open_columns")
