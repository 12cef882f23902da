"""Global shuffle into shards in two passes.

Pass one scatters the records by a seeded hash over buckets that fit in memory; pass two shuffles
each bucket by Fisher-Yates and writes it. The buckets one after the other are one permutation of
all records, which is cut into shards whose counts differ by one at most.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlake.llm.common import keep_table
from streamlake.session import run_dir

SHARDS = 40
SEED = 20_240_229
BUCKET_BYTES = 16 << 20
ROW_BYTES = 16  # counted per record beside its text
LAW = "rows"


def text_bytes(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def fisher_yates(seed: int):
    """A function that shuffles one bucket. The order is drawn from the seed and the bucket's number
    over the rows in a canonical order, so that a repeated task gives the same rows."""
    def shuffled(table: pa.Table) -> pa.Table:
        import numpy as np

        bucket = table.column("bucket")[0].as_py()
        keys = ["key", "doc_id", "check"]
        order = table.select(keys).to_pandas().sort_values(keys, kind="stable").index.to_numpy()
        draw = np.random.default_rng([seed, bucket])
        at = np.arange(len(order))
        draws = draw.random(len(order))
        for i in range(len(order) - 1, 0, -1):  # swap each with one that is not yet placed
            j = int(draws[i] * (i + 1))
            at[i], at[j] = at[j], at[i]
        table = table.take(pa.array(order[at]))
        place = pa.array(np.arange(len(order), dtype=np.int64))
        return table.drop_columns(["check", "key"]).append_column("place", place)

    return shuffled


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED,
          bucket_bytes: int = BUCKET_BYTES) -> str:
    """Write ``docs (doc_id, text)`` in shuffled order and return the folder of the shards.

    Files lie in ``shard=N`` folders with the columns ``doc_id, text, slot``; ``slot`` counts from 0
    without gaps. Null ids and texts are kept as they are; every row of a repeated row has a slot of
    its own; other columns are ignored; an empty table gives an empty folder of shards.

    A bucket is a share of the hash range: its size does not depend on what the rows hold, except
    that equal rows (same id and text) share one. Its number of rows is the only thing gathered.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    total = rows.agg(F.sum(text_bytes(F.col("text"))).alias("b")).first()["b"] or 0
    buckets = max(1, -(-total // bucket_bytes))
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    scattered = rows.select("doc_id", "text", key.alias("key"),
                            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
                            .alias("check"),
                            F.pmod(key, F.lit(buckets)).alias("bucket"))
    counts = keep_table(scattered.groupBy("bucket").count(), "shard-counts")
    before = F.sum("count").over(Window.orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    n = counts.agg(F.sum("count").alias("n")).first()["n"] or 0
    kinds = {f.name: f.dataType for f in scattered.schema}
    schema = T.StructType([T.StructField("doc_id", kinds["doc_id"]),
                           T.StructField("text", kinds["text"]),
                           T.StructField("bucket", T.LongType()),
                           T.StructField("place", T.LongType())])
    placed = scattered.groupBy("bucket").applyInArrow(fisher_yates(seed), schema)
    # The first `extra` shards hold one row more.
    each, extra = divmod(n, shards)
    rank, head = F.col("offset") + F.col("place"), extra * (each + 1)
    tail = rank - head
    width = max(each, 1)
    out = run_dir(spark, "shards")
    (placed.join(F.broadcast(offsets) if buckets <= 100_000 else offsets, "bucket")
     .withColumn("shard", F.when(rank < head, F.floor(rank / (each + 1)))
                 .otherwise(F.floor(tail / width) + extra).cast("int"))
     .withColumn("slot", F.when(rank < head, rank % (each + 1)).otherwise(tail % width))
     .select("doc_id", "text", "slot", "shard")
     .write.partitionBy("shard").option("compression", "zstd").parquet(out))
    return out


def read_shards(spark, path: str, schema: T.StructType) -> DataFrame:
    """The written records with their ``shard`` and ``slot``."""
    fields = [f for f in schema if f.name in ("doc_id", "text")]
    whole = T.StructType([*fields, T.StructField("slot", T.LongType()),
                          T.StructField("shard", T.IntegerType())])
    return spark.read.schema(whole).parquet(path)
