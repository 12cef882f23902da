"""Small helpers the operators of this package share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlake.session import configure, run_dir

# Fixed value: words are runs of anything but the ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


# What is handed to a Python task at once. The default counts rows only, and rows may be long.
BATCH_BYTES = 4 << 20
BROADCAST_IDS = 2_500_000  # numbers sent to every task at once, at most


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that results and memory bounds depend on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def keep_table(df: DataFrame, job: str, compression: str = "zstd") -> DataFrame:
    """Write a table below the shared folder and read it back: it survives lost executors, is
    computed once however often it is read, and its true size is known to later joins.

    The files belong to the job; whoever owns ``spark.checkpoint.dir`` clears them.
    """
    spark = df.sparkSession
    path = run_dir(spark, job)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def to_every_task(ids: DataFrame) -> DataFrame:
    """A written table of one number a row with the hint to broadcast it, unless it has more than
    ``BROADCAST_IDS`` rows: texts are picked out by it where they lie, while with more ids both sides
    of the join are shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def spaced_word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def partitions_for(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fetched(df: DataFrame):
    """A small result as a pandas frame, with the memory of its transfer given back."""
    table = df.toPandas()
    pa.default_memory_pool().release_unused()
    return table


def sample_of(df: DataFrame, rows: int, *key: Column) -> DataFrame:
    """About ``rows`` rows, twice that at most, chosen by a hash of ``key``: a share of the table by its
    number of rows, so that no task sends more than its part of the sample. The same rows each time."""
    share = min(1.0, rows / max(df.count(), 1))
    place = F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(1 << 31))
    return df.where(place < int(share * (1 << 31))).limit(2 * rows)


def in_blocks(df: DataFrame, size: Column, most: int, spread: Column) -> DataFrame:
    """Deal rows out so that any two rows of a group of ``size`` rows meet in some block of about
    ``2 * most`` at most, however large the group: the group is cut into ``n`` parts by ``spread``,
    and each row goes to the ``n`` pairs of parts that hold its own. Adds ``part, low, high``; rows
    of one part meet where ``low = high``. A group of up to ``most`` rows is one block."""
    parts = F.ceil(size / most)
    dealt = df.withColumn("part", F.pmod(spread, parts)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.withColumn("low", F.least("part", "other")).withColumn(
        "high", F.greatest("part", "other")).drop("other")


def runs(batches, columns: list[str]):
    """The record batches of a sorted partition as tables, one for each value of ``columns``."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        begin = 0
        for end in cuts:
            yield batch.slice(begin, int(end) - begin)
            begin = int(end)
        held = [batch.slice(begin)]
    yield from held
