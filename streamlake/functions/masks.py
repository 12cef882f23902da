"""Column masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MASK_KINDS = ("hash", "partial", "null")


def mask(column: Column, kind: str, data_type: str) -> Column:
    if kind == "hash":
        return F.upper(F.sha2(column.cast("string").cast("binary"), 256))
    if kind == "partial":
        return F.concat(F.substring(column.cast("string"), 1, 2), F.lit("***"))
    if kind == "null":
        return F.lit(None).cast(data_type)
    raise ValueError(f"unknown mask kind: {kind}")


def apply_masks(rows: DataFrame, masks: dict[str, str]) -> DataFrame:
    types = dict(rows.dtypes)
    return rows.withColumns({c: mask(F.col(c), kind, types[c]) for c, kind in masks.items()})
