"""Checks of access declarations. Findings are rows ``(code, subject, detail)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from streamlake.functions.masks import MASK_KINDS
from streamlake.functions.rowfilter import accepted
from streamlake.operators.graph import role_edges, strongly_connected
from streamlake.session import run_dir


def _finding(code: str, subject: Column, detail: Column) -> list[Column]:
    return [F.lit(code).alias("code"), subject.alias("subject"), detail.alias("detail")]


def cyclic_roles(roles: DataFrame) -> DataFrame:
    """Roles that reach themselves through inheritance.

    Edges whose role nobody includes, or whose parent includes nobody, are on no cycle. They are
    dropped while that takes off a tenth of the edges a round; the strongly connected components of
    the rest tell the roles on cycles, without building the closure's pairs.
    """
    spark = roles.sparkSession
    root = run_dir(spark, "cycles")
    edges, count, turn = role_edges(roles), None, 0
    while True:
        path = f"{root}/round={turn}"
        edges.write.parquet(path)
        edges = spark.read.schema(edges.schema).parquet(path)
        left = edges.count()
        if not left or (count is not None and left > 0.9 * count):
            break
        count, turn = left, turn + 1
        parents = edges.select(F.col("parent").alias("known")).distinct()
        children = edges.select(F.col("role").alias("known")).distinct()
        edges = (edges.join(parents, F.col("role") == F.col("known"), "left_semi")
                 .join(children, F.col("parent") == F.col("known"), "left_semi"))
    return strongly_connected(edges, "role", "parent").where("cyclic").select(
        *_finding("CYCLIC_INHERITANCE", F.col("node"), F.lit("")))


def pii_without_columns(resources: DataFrame) -> DataFrame:
    return (resources.where((F.col("classification") == "pii") & (F.size("sensitive_columns") == 0))
            .select(*_finding("PII_NO_SENSITIVE_COLUMNS", F.col("resource"), F.lit(""))))


def grant_exposure(resources: DataFrame, grants: DataFrame) -> DataFrame:
    """Grants with what they leave open of their resource: ``classification``, the sensitive columns
    a select grant shows unmasked in ``open_columns``, and whether that is declared to be wanted in
    ``allow_unmasked``. Grants on undeclared resources have no classification."""
    masked = F.coalesce(F.map_keys("column_mask"), F.array().cast("array<string>"))
    known = resources.select(F.col("resource").alias("of"), "classification", "sensitive_columns")
    sensitive = F.when(F.array_contains("privileges", "select"), F.filter(
        F.coalesce("sensitive_columns", F.array().cast("array<string>")),
        lambda c: ~F.array_contains(masked, c))).otherwise(F.array().cast("array<string>"))
    return (grants.join(known, F.col("resource") == F.col("of"), "left")
            .withColumn("open_columns", sensitive)
            .withColumn("allow_unmasked", F.coalesce("allow_unmasked", F.lit(False))).drop("of"))


def _pii_leak() -> Column:
    return ((F.col("classification") == "pii") & (F.size("open_columns") > 0)
            & ~F.col("allow_unmasked"))


def _grant_subject() -> Column:
    return F.concat("resource", F.lit("/"), "grant_id")


def pii_unmasked(resources: DataFrame, grants: DataFrame) -> DataFrame:
    """Select grants on personal data that leave a sensitive column unmasked."""
    return grant_exposure(resources, grants).where(_pii_leak()).select(
        *_finding("PII_UNMASKED", _grant_subject(), F.array_join("open_columns", ", ")))


def policy_lint(roles: DataFrame, groups: DataFrame, resources: DataFrame,
                grants: DataFrame) -> DataFrame:
    """All findings. The grants are read once: each gives one row with what can be said of it alone
    and with its resource, and one row for each role it names, which is then looked up."""
    alone = F.array_compact(F.array(
        F.when(_pii_leak(), F.struct(*_finding("PII_UNMASKED", _grant_subject(),
                                               F.array_join("open_columns", ", ")))),
        F.when(F.col("row_filter").isNotNull() & ~accepted(F.col("row_filter")),
               F.struct(*_finding("ROW_FILTER_REJECTED", _grant_subject(), F.col("row_filter"))))))
    named = F.transform("roles", lambda role: F.struct(
        *_finding("UNKNOWN_ROLE", _grant_subject(), role)))
    of_grants = grant_exposure(resources, grants).select(F.explode(F.concat(alone, named)).alias("f"))

    def references(rows: DataFrame, kind: str, column: str) -> DataFrame:
        subject = F.concat(F.lit(f"{kind}/"), "name")
        return rows.select(F.explode(F.transform(column, lambda role: F.struct(
            *_finding("UNKNOWN_ROLE", subject, role)))).alias("f"))

    said = (of_grants.unionByName(references(roles, "role", "includes"))
            .unionByName(references(groups, "group", "roles")).select("f.*"))
    declared = roles.select(F.col("name").alias("known")).distinct()
    found = said.join(declared, (F.col("code") == "UNKNOWN_ROLE") & (F.col("detail") == F.col("known")),
                      "left_anti")
    return reduce(DataFrame.unionByName, [found, cyclic_roles(roles), pii_without_columns(resources)])


def fold_role_name(name: Column) -> Column:
    """Role name as the database spells it."""
    return F.lower(F.translate(name, "-", "_"))


def role_name_collisions(roles: DataFrame) -> DataFrame:
    """Different role names that fold to one; the first and the last of them are shown."""
    return (roles.groupBy(fold_role_name(F.col("name")).alias("folded"), "name").agg(F.lit(1))
            .groupBy("folded").agg(F.count("*").alias("spellings"),
                                   F.min("name").alias("first_name"),
                                   F.max("name").alias("last_name"))
            .where("spellings > 1"))


def duplicate_catalog_grants(grants: DataFrame) -> DataFrame:
    """Catalog grants that repeat a catalog and role set, in whatever order the roles are named."""
    role_set = F.array_join(F.array_sort(F.array_distinct("roles")), ",")
    return (grants.groupBy("catalog", role_set.alias("role_set"))
            .agg(F.count("*").alias("grant_count")).where("grant_count > 1"))


def conflicting_masks(grants: DataFrame) -> DataFrame:
    """Columns a role sees under different masks by different grants. The masks met are kept as
    bits, which a hash aggregate combines ahead of the shuffle."""
    bit = F.create_map(*[F.lit(x) for i, kind in enumerate(MASK_KINDS) for x in (kind, 1 << i)])
    met = [F.when(F.col("bits").bitwiseAND(1 << i) != 0, kind) for i, kind in enumerate(MASK_KINDS)]
    return (grants.select("resource", F.explode("roles").alias("role"), "column_mask")
            .select("resource", "role", F.explode("column_mask").alias("column_name", "mask"))
            .groupBy("resource", "role", "column_name")
            .agg(F.bit_or(F.coalesce(bit[F.col("mask")], F.raise_error(F.concat(
                F.lit("unknown mask: "), F.coalesce("mask", F.lit("null")))).cast("int"))).alias("bits"))
            .where(F.bit_count("bits") > 1)
            .select("resource", "role", "column_name", F.concat_ws(", ", *met).alias("masks")))
