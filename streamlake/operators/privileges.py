"""Table privileges: schema-wide grants, revokes and role inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from streamlake.policy import PRIVILEGES, Policy

KEY = ["role", "privilege", "schema_name", "table_name"]

# Who is granted what on all relations of a schema, on those created later, and
# what is revoked on relations with personal data.
SCHEMA_GRANTS = {"analysts": ["select"], "engineers": PRIVILEGES, "admins": PRIVILEGES}
DEFAULT_GRANTS = {"engineers": PRIVILEGES, "admins": PRIVILEGES}
PII_REVOKES = {"analysts": ["select"]}


def effective_privileges(grants: DataFrame, revokes: DataFrame, holders: DataFrame) -> DataFrame:
    """Grants less revokes, both as tables, passed on to every role that holds the granted one."""
    standing = grants.join(revokes, KEY, "left_anti")
    return (standing.join(holders, "role")
            .select(F.col("holder").alias("role"), "privilege", "schema_name", "table_name")
            .distinct())


def held_privileges(granted: dict, revoked: dict, policy: Policy) -> Column:
    """Array of ``(role, privilege)`` that the grants leave once revokes are taken off and the rest
    is passed on to the holders of each role."""
    held = {(holder, privilege) for role, privileges in granted.items() for privilege in privileges
            if privilege not in revoked.get(role, ()) for holder in policy.holders_of(role)}
    return F.array(*[F.struct(F.lit(role).alias("role"), F.lit(privilege).alias("privilege"))
                     for role, privilege in sorted(held)])


def with_privileges(relations: DataFrame, policy: Policy) -> DataFrame:
    """Relations ``(schema_name, table_name, is_new, is_pii)`` with ``held``: analysts read the
    relations that existed at grant time and hold no personal data; engineers and admins have
    all privileges, on later relations too. Decided in the row, without join or shuffle."""
    return relations.withColumn("held", (
        F.when(F.col("is_new"), held_privileges(DEFAULT_GRANTS, {}, policy))
        .when(F.col("is_pii"), held_privileges(SCHEMA_GRANTS, PII_REVOKES, policy))
        .otherwise(held_privileges(SCHEMA_GRANTS, {}, policy))))


def relation_privileges(relations: DataFrame, policy: Policy) -> DataFrame:
    """One row per role, privilege and relation; a relation stands in one row."""
    return with_privileges(relations, policy).select(
        F.explode("held").alias("p"), "schema_name", "table_name").select(
        "p.role", "p.privilege", "schema_name", "table_name")


# What all privileges of a kind of object are, and who is granted what on the objects of
# a database that exist at grant time; later tables follow ``DEFAULT_GRANTS``, later objects of other
# kinds are granted to nobody.
ALL_PRIVILEGES = {
    "table": (*PRIVILEGES, "truncate", "references", "trigger"),
    "sequence": ("usage", "select", "update"), "schema": ("usage", "create"),
    "database": ("create", "connect", "temporary")}
OBJECT_GRANTS = {
    "table": {"analysts": ("select",), "engineers": ("all",), "admins": ("all",)},
    "sequence": {"engineers": ("all",), "admins": ("all",)},
    "schema": {role: ("usage",) for role in ("analysts", "engineers", "admins")},
    "database": {"analysts": ("connect",), "engineers": ("connect",), "admins": ("connect", "all")}}
LATER_TABLES = {"engineers": ("all",), "admins": ("all",)}


def object_privileges(objects: DataFrame, policy: Policy) -> DataFrame:
    """Privileges on any object ``(kind, name, is_new, is_pii)`` of a database, with all privileges of a
    kind spelled out; decided in the row. An unknown kind fails."""
    def held(kind: str, granted: dict, revoked: dict | None = None) -> Column:
        spelled = {role: [p for q in privileges for p in (ALL_PRIVILEGES[kind] if q == "all" else (q,))]
                   for role, privileges in granted.items()}
        return held_privileges(spelled, revoked or {}, policy)

    kind, nobody = F.col("kind"), F.array().cast("array<struct<role:string,privilege:string>>")
    rows = F.when(kind == "table", F.when(F.col("is_new"), held("table", LATER_TABLES))
                  .when(F.col("is_pii"), held("table", OBJECT_GRANTS["table"], PII_REVOKES))
                  .otherwise(held("table", OBJECT_GRANTS["table"])))
    for other in ("sequence", "schema", "database"):
        rows = rows.when(kind == other, F.when(F.col("is_new"), nobody).otherwise(
            held(other, OBJECT_GRANTS[other])))
    rows = rows.otherwise(F.raise_error(F.concat(F.lit("unknown kind of object: "),
                                                 F.coalesce(kind, F.lit("null"))))
                          .cast("array<struct<role:string,privilege:string>>"))
    return objects.select(F.explode(rows).alias("p"), "kind", "name").select("p.*", "kind", "name")


def privilege_lists(effective: DataFrame) -> DataFrame:
    """One row per role and relation with its privileges in their customary order. They are
    gathered as bits, which a hash aggregate combines ahead of the shuffle."""
    bit = F.create_map(*[F.lit(x) for i, p in enumerate(PRIVILEGES) for x in (p, 1 << i)])
    held = [F.when(F.col("bits").bitwiseAND(1 << i) != 0, p) for i, p in enumerate(PRIVILEGES)]
    return (effective.groupBy("role", "schema_name", "table_name")
            .agg(F.bit_or(F.coalesce(bit[F.col("privilege")], F.raise_error(F.concat(
                F.lit("unknown privilege: "), F.coalesce("privilege", F.lit("null")))).cast("int")))
                .alias("bits"))
            .select("role", "schema_name", "table_name",
                    F.concat_ws(", ", *held).alias("privileges")))


def has_privilege(effective: DataFrame, role: str, table: str, privilege: str) -> DataFrame:
    """One row, one truth value: does the role hold the privilege on ``schema.table``?"""
    schema, name = table.rsplit(".", 1)
    held = ((F.col("role") == role) & (F.col("privilege") == privilege)
            & (F.col("schema_name") == schema) & (F.col("table_name") == name))
    return effective.where(held).agg((F.count("*") > 0).alias("has_privilege"))


def default_deny_probe(relations: DataFrame, policy: Policy) -> DataFrame:
    """For each relation created after the grants: can each role read it?"""
    def can_read(role: str) -> Column:
        return F.exists("held", lambda p: (p["role"] == role) & (p["privilege"] == "select"))

    return with_privileges(relations.where("is_new"), policy).select(
        "schema_name", "table_name", can_read("analysts").alias("analyst_select"),
        can_read("engineers").alias("engineer_select"), can_read("admins").alias("admin_select"))
