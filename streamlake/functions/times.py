"""Timestamp expressions that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def truncate_millis(ts: Column) -> Column:
    """Millisecond precision, cut off rather than rounded."""
    excess = F.date_part(F.lit("SECOND"), ts) % F.lit("0.001").cast("decimal(4,3)")
    zero = F.lit(0)
    return ts - F.make_dt_interval(zero, zero, zero, excess.cast("decimal(18,6)"))


def parse_iso(text: Column) -> Column:
    """ISO text, with or without ``T``, ``Z`` and fraction -> zone-less milliseconds timestamp.

    Text that is no timestamp fails the job.
    """
    plain = F.replace(F.replace(text, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))
    return truncate_millis(plain.cast("timestamp_ntz"))
