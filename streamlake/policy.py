"""Access declarations: roles, groups, resources and grants as small Python values, and as
DataFrames to join with logs and tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from streamlake.functions.masks import MASK_KINDS

TEXT, TEXTS = pa.string(), pa.list_(pa.string())

# Classes of data, and the privileges in their customary order.
CLASSIFICATIONS = ("public", "internal", "pii")
PRIVILEGES = ("select", "insert", "update", "delete")


def small_frame(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """Declared rows as a relation Spark knows the size of, so that it can plan a broadcast."""
    arrays = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(columns.values())]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(columns)))


@dataclass(frozen=True)
class Grant:
    resource: str
    roles: tuple[str, ...]
    privileges: tuple[str, ...]
    column_mask: dict[str, str] = field(default_factory=dict)
    row_filter: str | None = None
    allow_unmasked: bool = False


@dataclass(frozen=True)
class Policy:
    roles: dict[str, tuple[str, ...]]                       # role -> roles it includes
    groups: dict[str, tuple[str, ...]]                      # group -> roles
    resources: dict[str, tuple[str, tuple[str, ...]]]       # name -> (class, sensitive columns)
    grants: tuple[Grant, ...]
    catalog_grants: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]

    def effective_roles(self, role: str) -> set[str]:
        found, todo = set(), [role]
        while todo:
            name = todo.pop()
            if name not in found:
                found.add(name)
                todo.extend(self.roles.get(name, ()))
        return found

    def holders_of(self, role: str) -> set[str]:
        return {name for name in self.roles if role in self.effective_roles(name)}

    def holders(self, spark: SparkSession) -> DataFrame:
        rows = [(r, h) for r in sorted(self.roles) for h in sorted(self.holders_of(r))]
        return small_frame(spark, rows, role=TEXT, holder=TEXT)

    def roles_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r, list(inc)) for r, inc in self.roles.items()]
        return small_frame(spark, rows, name=TEXT, includes=TEXTS)

    def groups_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(g, list(roles)) for g, roles in self.groups.items()]
        return small_frame(spark, rows, name=TEXT, roles=TEXTS)

    def resources_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r, c, list(s)) for r, (c, s) in self.resources.items()]
        return small_frame(spark, rows, resource=TEXT, classification=TEXT, sensitive_columns=TEXTS)

    def grants_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(f"grant-{i}", g.resource, list(g.roles), list(g.privileges),
                 list(g.column_mask.items()),
                 g.row_filter, g.allow_unmasked) for i, g in enumerate(self.grants)]
        return small_frame(spark, rows, grant_id=TEXT, resource=TEXT, roles=TEXTS, privileges=TEXTS,
                           column_mask=pa.map_(TEXT, TEXT), row_filter=TEXT,
                           allow_unmasked=pa.bool_())


def split_resource(resource: Column) -> tuple[Column, Column]:
    """``schema.table`` -> (schema, table), cut at the last dot."""
    table = F.substring_index(resource, ".", -1)
    return F.substring(resource, F.lit(1), F.length(resource) - F.length(table) - 1), table


def from_mapping(document: dict) -> Policy:
    """Policy from the parsed declaration files (``roles``, ``groups``, ``resources`` and
    ``catalogGrants`` sections). Refused are unknown keys, classes, privileges and masks, names that
    are empty or declared twice, and empty lists of roles, privileges or operations."""
    def take(entry: dict, required: set[str], optional: set[str]) -> dict:
        missing, unknown = required - set(entry), set(entry) - required - optional
        if missing or unknown:
            raise ValueError(f"declaration entry {entry}: missing {sorted(missing)}, "
                             f"unknown {sorted(unknown)}")
        return entry

    def names(entry: dict, key: str, some: bool = True) -> tuple[str, ...]:
        listed = entry.get(key, ())
        if isinstance(listed, str) or (some and not listed) or not all(
                isinstance(x, str) and x for x in listed):
            raise ValueError(f"declaration entry {entry}: {key} must list names")
        return tuple(listed)

    def once(entries: list[tuple], what: str) -> dict:
        found = {}
        for name, value in entries:
            if not isinstance(name, str) or not name:
                raise ValueError(f"a {what} without name")
            if name in found:
                raise ValueError(f"{what} {name} is declared twice")
            found[name] = value
        return found

    take(document, set(), {"roles", "groups", "resources", "catalogGrants"})
    roles = once([(r["name"], names(take(r, {"name"}, {"includes"}), "includes", False))
                  for r in document.get("roles", ())], "role")
    groups = once([(g["name"], names(take(g, {"name", "roles"}, set()), "roles"))
                   for g in document.get("groups", ())], "group")
    resources, grants = [], []
    for entry in document.get("resources", ()):
        take(entry, {"resource", "classification", "grants"}, {"sensitiveColumns"})
        if entry["classification"] not in CLASSIFICATIONS:
            raise ValueError(f"unknown classification: {entry['classification']}")
        resources.append((entry["resource"], (entry["classification"],
                                              names(entry, "sensitiveColumns", False))))
        for g in entry["grants"]:
            take(g, {"roles", "privileges"}, {"columnMask", "rowFilter", "allowUnmasked"})
            if not set(names(g, "privileges")) <= set(PRIVILEGES):
                raise ValueError(f"unknown privilege: {g['privileges']}")
            masks = dict(g.get("columnMask", {}))
            if not set(masks.values()) <= set(MASK_KINDS):
                raise ValueError(f"unknown mask: {masks}")
            grants.append(Grant(entry["resource"], names(g, "roles"), names(g, "privileges"), masks,
                                g.get("rowFilter"), bool(g.get("allowUnmasked", False))))
    catalog_grants = tuple(
        (c["catalog"], names(c, "roles"), names(c, "operations"))
        for c in (take(c, {"catalog", "roles", "operations"}, set())
                  for c in document.get("catalogGrants", ())))
    return Policy(roles, groups, once(resources, "resource"), tuple(grants), catalog_grants)


# The shipped declaration. The three roles inherit upwards; catalog-level
# operations cover browsing as well.
SHIPPED = from_mapping({
    "roles": [{"name": "analysts"},
              {"name": "engineers", "includes": ["analysts"]},
              {"name": "admins", "includes": ["engineers"]}],
    "groups": [{"name": "analyst", "roles": ["analysts"]},
               {"name": "engineer", "roles": ["engineers"]},
               {"name": "admin", "roles": ["admins"]}],
    "resources": [
        {"resource": "lake.events_enriched", "classification": "internal", "grants": [
            {"roles": ["analysts"], "privileges": ["select"]},
            {"roles": ["engineers"], "privileges": ["select", "insert", "update", "delete"]}]},
        {"resource": "lake.orders", "classification": "internal", "grants": [
            {"roles": ["analysts"], "privileges": ["select"]},
            {"roles": ["engineers"], "privileges": ["select", "insert", "update", "delete"]}]},
        {"resource": "lake.customers", "classification": "pii", "sensitiveColumns": ["email"],
         "grants": [
            {"roles": ["engineers"], "privileges": ["select", "insert", "update", "delete"],
             "allowUnmasked": True}]}],
    "catalogGrants": [
        {"catalog": "iceberg", "roles": ["analysts"], "operations": [
            "ExecuteQuery", "AccessCatalog", "ShowSchemas", "ShowTables", "ShowColumns",
            "ShowCreateTable", "ShowFunctions", "SetCatalogSessionProperty", "FilterCatalogs",
            "FilterSchemas", "FilterTables"]}]})
