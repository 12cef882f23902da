"""Change-data capture: normalisation, mirroring, keyed merge and point-in-time views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from streamlake.functions.times import parse_iso
from streamlake.session import run_dir


def normalize(envelopes: DataFrame) -> DataFrame:
    """Envelopes -> one row per change: the row image, ``op``, ``ts_ms`` and ``seq``.

    Inserts, reads and updates carry the image after the change, deletes the one before it. An
    update or delete without its before-image fails, as do an unknown operation code and a change
    without any position in the log.
    """
    op, before, after = F.col("op"), F.col("before"), F.col("after")
    image = (F.when(op.isin("c", "r"), after)
             .when((op == "u") & before.isNotNull(), after)
             .when((op == "d") & before.isNotNull(), before)
             .otherwise(F.raise_error(F.concat(
                 F.lit("change record without usable row image, op="),
                 F.coalesce(op, F.lit("null"))))))
    seq = F.coalesce("seq", "source.lsn") if "source" in envelopes.columns else F.col("seq")
    seq = F.when(seq.isNull() & F.col("ts_ms").isNull(), F.raise_error(
        F.lit("change record without position")).cast("bigint")).otherwise(seq)
    return (envelopes.select(image.alias("image"), "op", "ts_ms", seq.alias("seq"))
            .select("image.*", "op", "ts_ms", "seq"))


def mirror_orders(changes: DataFrame) -> DataFrame:
    """Typed columns of the orders mirror; a bad or too large amount fails the job."""
    return changes.withColumns({
        "total_amount": F.col("total_amount").cast("decimal(10,2)"),
        "updated_at": parse_iso(F.col("updated_at"))})


def mirror_customers(changes: DataFrame) -> DataFrame:
    return changes.withColumn("created_at", parse_iso(F.col("created_at")))


def bootstrap(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """Table snapshot, tagged as reads at position 0, followed by the changes after it."""
    first = snapshot.withColumns({"op": F.lit("r"), "ts_ms": F.lit(0).cast("bigint"),
                                  "seq": F.lit(0).cast("bigint")})
    return first.unionByName(tail.where("op <> 'r'"))


def latest_per_key(changes: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Last change of every key, by position, then time; of equals, a delete before others, then by a
    digest of the row, so that the choice is the same every time. The rank filter is also applied
    ahead of the shuffle, so each input partition sends one row per key however often a key changed."""
    newest = Window.partitionBy(key).orderBy(
        F.col(order).desc(), F.col("ts_ms").desc(), (F.col("op") == "d").desc(),
        F.xxhash64(*changes.columns).desc())
    return (changes.withColumn("rank", F.row_number().over(newest))
            .where("rank = 1").drop("rank"))


def current_rows(changes: DataFrame, key: str) -> DataFrame:
    """Table state after all changes."""
    return latest_per_key(changes, key).where("op <> 'd'").drop("op", "ts_ms")


def chunked_bootstrap(chunks: DataFrame, windows: DataFrame, tail: DataFrame, key: str,
                      chunk_of) -> DataFrame:
    """A snapshot read in chunks while the log goes on, made consistent with the log.

    ``chunks`` are snapshot rows with the ``chunk`` (key range) they were read in; ``windows`` gives
    each chunk's ``low`` and ``high`` log positions, taken just before and just after its read;
    ``tail`` is the log from the first chunk's ``low`` on, its order in ``position``; ``chunk_of``
    maps a key column to its chunk. A snapshot row whose key changed between its chunk's ``low`` and
    ``high`` may show that change or not, so it loses: it is dropped (anti-join) and the log's own
    images stand. The others enter as reads at their chunk's ``high``. Returns that stream and the
    tail, by ``position``. Windows are one row per chunk and are joined by chunk number, not by range.
    """
    overtaken = (tail.withColumn("chunk", chunk_of(F.col(key))).join(windows, "chunk")
                 .where((F.col("position") > F.col("low")) & (F.col("position") <= F.col("high")))
                 .select(key).distinct())
    kept = (chunks.join(overtaken, key, "left_anti").join(windows, "chunk")
            .withColumns({"op": F.lit("r"), "position": F.col("high")})
            .drop("chunk", "low", "high"))
    return kept.unionByName(tail, allowMissingColumns=True)


def history(changes: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Every image of every key with its validity: from its change's time up to the next change of
    the key (a delete ends the last image and is none itself); the newest image stays open (null
    ``valid_to``). Changes are ordered as in ``latest_per_key``; ``ts_ms`` becomes the times."""
    by_key = Window.partitionBy(key).orderBy(
        F.col(order), F.col("ts_ms"), (F.col("op") == "d"), F.xxhash64(*changes.columns))
    at = F.timestamp_millis("ts_ms").cast("timestamp_ntz")
    timed = changes.withColumns({"valid_from": at, "valid_to": F.lead(at).over(by_key)})
    return timed.where(F.col("op") != "d").drop("ts_ms", order)


def as_of(changes: DataFrame, key: str, ts_ms: int) -> DataFrame:
    """Table state at a moment."""
    return current_rows(changes.where(F.col("ts_ms") <= ts_ms), key)


def merge(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Target after the changes: untouched rows plus the surviving new images.

    The last images are written below the shared folder first: the log is read and parsed once, and
    the planner knows how large they are. While their keys fit a broadcast the target stays where
    it is; otherwise both sides are sorted and merged.
    """
    spark = changes.sparkSession
    path, last = run_dir(spark, "merge"), latest_per_key(changes, key)
    last.write.parquet(path)
    last = spark.read.schema(last.schema).parquet(path)
    kept = target.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("op <> 'd'").select(*target.columns))


def merge_into(changes: DataFrame, table: str, key: str) -> None:
    """The same merge on a table format with row-level operations (a catalog table)."""
    last = latest_per_key(changes, key)
    row = {c: F.col(f"s.{c}") for c in last.columns if c not in ("op", "ts_ms", "seq")}
    (last.alias("s").mergeInto(table, F.expr(f"{table}.{key} = s.{key}"))
     .whenMatched(F.col("s.op") == "d").delete()
     .whenMatched().update(row)
     .whenNotMatched(F.col("s.op") != "d").insert(row)
     .merge())
