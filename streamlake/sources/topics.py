"""JSON records on topics: schemas, decoding, encoding, and the streams that carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

CLICK_SCHEMA = ("event_id STRING, user_id STRING, page STRING, action STRING, "
                "timestamp TIMESTAMP_NTZ, duration_ms INT")
ORDER_ROW = ("order_id BIGINT, customer_id BIGINT, total_amount STRING, status STRING, "
             "updated_at STRING")
CUSTOMER_ROW = "customer_id BIGINT, name STRING, email STRING, city STRING, created_at STRING"


def envelope_schema(row: str) -> str:
    """Change record: row images before and after, operation code, source time and position. The
    position is ``seq``, or else the log sequence number the connector names in ``source``."""
    return (f"before STRUCT<{row}>, after STRUCT<{row}>, op STRING, ts_ms BIGINT, seq BIGINT, "
            "source STRUCT<lsn BIGINT>")


def decode(records: DataFrame, schema: str) -> DataFrame:
    """Records with a ``value`` (text or binary JSON) -> typed columns.

    Malformed input fails the job. Records without a value carry no row and are skipped. The
    text is parsed in a generator: filters on the parsed columns stay above it, where in a
    projection Spark would push them down and parse every record once more for each.
    """
    parsed = F.from_json(F.col("value").cast("string"), schema, {"mode": "FAILFAST"})
    return records.select(F.inline(F.array_compact(F.array(parsed))))


def encode(rows: DataFrame, key: str | Column | None = None) -> DataFrame:
    """One JSON record per row in ``value``; ``key`` keeps changes of one row on one partition."""
    value = F.to_json(F.struct("*"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    if key is None:
        return rows.select(value.alias("value"))
    key = F.col(key) if isinstance(key, str) else key
    return rows.select(key.cast("string").alias("key"), value.alias("value"))


def topic_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Topic from its earliest offset; progress is kept in the query's checkpoint."""
    return spark.readStream.format("kafka").options(**topic_options(servers, topic)).load()


def write_topic(records: DataFrame, servers: str, topic: str, checkpoint: str):
    return (records.writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint))


def stream_table(spark: SparkSession, path: str, schema: StructType,
                 files_per_trigger: int | None = None) -> DataFrame:
    """Parquet table as a stream. ``path`` may be one file or a folder of part files.

    The last character is written as a one-letter glob: the file source takes a plain
    path as a folder only, but resolves a glob to either.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")
