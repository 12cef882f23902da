"""Desired against actual state of the identity directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def drift(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """Compare rows ``(object, name, roles)``, object being role or group.

    Roles compare by name, groups by their sorted role list. ``expected`` and ``found`` are the
    role lists of the two sides, null where a side lacks the object. Groups that only exist in the
    actual state are not reported.
    """
    def listed(side: DataFrame, column: str) -> DataFrame:
        return side.select("object", "name",
                           F.array_join(F.array_sort("roles"), ",").alias(column))

    want, have = F.col("want"), F.col("have")
    kind = (F.when(have.isNull(), "unapplied")
            .when(want.isNull() & (F.col("object") == "role"), "manual")
            .when((F.col("object") == "group") & (want != have), "mismatch"))
    return (listed(desired, "want").join(listed(actual, "have"), ["object", "name"], "full_outer")
            .select(kind.alias("kind"), F.concat("object", F.lit("/"), "name").alias("target"),
                    want.alias("expected"), have.alias("found"))
            .where(F.col("kind").isNotNull()))


def drift_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("kind").agg(F.count("*").alias("items"))
