"""Load operators: insert-ignore, insert into an empty table, foreign-key check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SEED_CUSTOMERS = """
    VALUES ('First Tester', 'first@example.org', 'Northtown'),
           ('Second Tester', 'second@example.org', 'Southtown') AS seed(name, email, city)"""
SEED_ORDERS = """
    VALUES (1, 12.50, 'OPEN'), (2, 7.25, 'PAID'), (2, 99.00, 'SENT'), (3, 0.75, 'OPEN')
        AS seed(customer_id, total_amount, status)"""


def seed(spark: SparkSession, values: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {values}")


def insert_ignore(target: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Target plus the incoming rows whose key is new; of several with one key, the first by
    ``order`` enters. Only the target's key column takes part in the lookup."""
    first = Window.partitionBy(key).orderBy(order)
    fresh = (incoming.withColumn("rank", F.row_number().over(first)).where("rank = 1")
             .join(target.select(key), key, "left_anti"))
    return target.unionByName(fresh.select(*target.columns))


def insert_if_empty(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Target plus the incoming rows if the target has none; probes a single row of it."""
    rows = incoming.sparkSession.sql(
        "SELECT * FROM {incoming} WHERE NOT EXISTS (SELECT 1 FROM {target})",
        incoming=incoming, target=target)
    return target.unionByName(rows.select(*target.columns))


def fk_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose reference has no parent; a null reference is no violation."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def unique_violations(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that stand in more than one row, with the number of rows; keys with a null part are not
    compared. Counts are combined ahead of the shuffle."""
    whole = rows.select(*key).dropna("any")
    return whole.groupBy(*key).agg(F.count("*").alias("row_count")).where("row_count > 1")


def not_null_violations(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """``(key, column_name)`` for every null in one of the columns."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in columns]))
    return rows.select(key, F.explode(missing).alias("column_name"))


def length_violations(rows: DataFrame, key: str, **most: int) -> DataFrame:
    """``(key, column_name, length)`` for every text longer than its column allows."""
    long = F.array_compact(F.array(*[
        F.when(F.length(c) > n, F.struct(F.lit(c).alias("column_name"), F.length(c).alias("length")))
        for c, n in most.items()]))
    return rows.select(key, F.explode(long).alias("x")).select(key, "x.*")
