"""Table maintenance: small files of a table are merged, large ones stay where they are."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from streamlake.session import run_dir

SMALL_FILE_BYTES = 100 * 1024 * 1024
TARGET_FILE_BYTES = 512 * 1024 * 1024
PLAN = "folder string, path string, bytes bigint, rewrite_group bigint"


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, path, bytes)`` of the Parquet files of a table, from the file system's listing; no
    file is opened. ``folder`` tells the partitions of a partitioned table apart."""
    return _listing(spark, path).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "path",
                                        F.col("length").alias("bytes"))


def _listing(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
            .option("recursiveFileLookup", "true").load(path))


def compaction_plan(files: DataFrame, small_bytes: int = SMALL_FILE_BYTES,
                    target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """Assign the small files of each folder to rewrite groups of about ``target_bytes``. Files that
    would be alone in their group are left out, as are those of ``small_bytes`` and more.

    Groups follow a running total of sizes in the order of the path digests. A running total over a
    whole folder would put it in one task, so it is built in two steps: totals per 4096 digest
    ranges (that many rows per folder at most), then inside each range.
    """
    small = (files.where(F.col("bytes") < small_bytes)
             .withColumn("digest", F.md5(F.col("path").cast("binary")))
             .withColumn("slice", F.substring("digest", 1, 3)))
    earlier = (Window.partitionBy("folder").orderBy("slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (small.groupBy("folder", "slice").agg(F.sum("bytes").alias("slice_bytes"))
               .select("folder", "slice",
                       F.coalesce(F.sum("slice_bytes").over(earlier), F.lit(0)).alias("offset")))
    inside = (Window.partitionBy("folder", "slice").orderBy("digest", "path")
              .rowsBetween(Window.unboundedPreceding, -1))
    grouped = (small.withColumn("before", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
               .join(offsets, ["folder", "slice"])
               .select("folder", "path", "bytes",
                       F.expr(f"(offset + before) DIV {target_bytes}").alias("rewrite_group")))
    several = (grouped.groupBy("folder", "rewrite_group").count().where("count > 1")
               .select("folder", "rewrite_group"))
    return grouped.join(several, ["folder", "rewrite_group"], "left_semi").select(
        "folder", "path", "bytes", "rewrite_group")


def compact(spark: SparkSession, source: str, destination: str, small_bytes: int = SMALL_FILE_BYTES,
            target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """Merge the small files of the table at ``source`` into files below ``destination``, which keeps
    the table's partitioning, and return the plan that was carried out. Nothing of the source is
    changed; ``compacted`` reads its other files together with the merged ones.

    Only rows of planned files are read and moved, once, to the task of their group. A row knows its file
    in Spark's encoded spelling, which the listing gives beside the plain path. Fails if the merged
    files do not hold as many rows as the planned ones.
    """
    path = run_dir(spark, "compaction-plan")
    compaction_plan(data_files(spark, source), small_bytes, target_bytes).write.parquet(path)
    plan = spark.read.schema(PLAN).parquet(path)
    planned = [r.path for r in plan.select("path").collect()]  # a listing, as Spark's own driver holds
    if planned:
        rows = spark.read.option("basePath", source).parquet(*planned)
        columns, place = rows.columns, F.col("_metadata.file_path")
        spelt = _listing(spark, source).select("path", F.col("_metadata.file_path").alias("_spelt"))
        groups = plan.join(spelt, "path").select("_spelt", "folder", "rewrite_group")
        split = _partition_columns(spark, source, rows)
        merged = (rows.select("*", place.alias("_path"))
                  .join(groups, F.col("_path") == F.col("_spelt"))
                  .repartition("folder", "rewrite_group").select(*columns))
        merged.write.partitionBy(*split).parquet(destination)
        wanted, written = rows.count(), spark.read.parquet(destination).count()
        if written != wanted:
            raise RuntimeError(f"{written} rows merged into {destination}, {wanted} planned from {source}")
    return plan


def _partition_columns(spark: SparkSession, source: str, rows: DataFrame) -> list[str]:
    """Columns of a table that come from its folders and are not in its files."""
    first = data_files(spark, source).select("path").first()
    stored = spark.read.parquet(first.path).columns if first else rows.columns
    return [c for c in rows.columns if c not in stored]


def compacted(spark: SparkSession, source: str, destination: str, plan: DataFrame) -> DataFrame:
    """The table after ``compact``: the files it left alone and those it wrote."""
    left = data_files(spark, source).join(plan.select("path"), "path", "left_anti")
    kept = [r.path for r in left.select("path").collect()]
    parts = [spark.read.option("basePath", source).parquet(*kept)] if kept else []
    if not plan.isEmpty():
        parts.append(spark.read.parquet(destination))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


RETENTION_DAYS = 7


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def expire_superseded(spark: SparkSession, source: str, plan: DataFrame, now: datetime,
                      retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Delete the files of ``source`` that a carried-out compaction ``plan`` merged elsewhere and that
    were last modified more than ``retention_days`` before ``now``; files the plan does not name are in
    use and stay. Deletion goes through the file system Spark writes with. Returns ``(path, bytes)`` of
    the deleted files.

    The listing comes from the file system (no file is opened); the names to delete are the plan's, a
    list of the kind Spark's own driver keeps of a table's files.
    """
    cutoff = now.timestamp() * 1000 - retention_days * 86_400_000
    listing = _listing(spark, source).select("path", F.col("length").alias("bytes"),
                                             (F.unix_millis("modificationTime")).alias("modified"))
    old = (listing.join(plan.select("path"), "path", "left_semi")
           .where(F.col("modified") < F.lit(cutoff)).select("path", "bytes"))
    doomed = old.collect()
    for row in doomed:
        path, fs = _file_system(spark, row.path)
        if fs.exists(path):
            fs.delete(path, False)
    return spark.createDataFrame(doomed, "path string, bytes bigint")


def clear_runs(spark: SparkSession, now: datetime, retention_days: int = RETENTION_DAYS,
               root: str | None = None) -> list[str]:
    """Delete the job folders (``run_dir``) below ``root`` (by default the shared folder's) last changed
    more than ``retention_days`` before ``now``; whoever owns the shared folder calls this when no
    result of those runs is read any more. Returns the deleted folders."""
    from streamlake.session import shared_dir

    folder, fs = _file_system(spark, root or f"{shared_dir(spark)}/streamlake")
    if not fs.exists(folder):
        return []
    cutoff = now.timestamp() * 1000 - retention_days * 86_400_000
    gone = []
    for status in fs.listStatus(folder):
        if status.isDirectory() and status.getModificationTime() < cutoff:
            fs.delete(status.getPath(), True)
            gone.append(status.getPath().toString())
    return gone


def maintain(spark: SparkSession, tables: dict[str, tuple[str, str]], catalog: str | None = None,
             older_than: datetime | None = None) -> dict[str, DataFrame]:
    """Hourly job body: compact the tables ``{name: (source, destination)}``, and only then have a
    catalog expire their snapshots. Returns the plan of each table."""
    plans = {name: compact(spark, *places) for name, places in tables.items()}
    if catalog:
        for name in tables:
            expire_catalog_table(spark, catalog, name, older_than)
    return plans


def compact_catalog_table(spark: SparkSession, catalog: str, table: str) -> None:
    """The same on an Iceberg catalog table, by its own procedure."""
    spark.sql(f"CALL {catalog}.system.rewrite_data_files(table => '{table}')")


def expire_catalog_table(spark: SparkSession, catalog: str, table: str, older_than: datetime) -> None:
    spark.sql(f"CALL {catalog}.system.expire_snapshots(table => '{table}', "
              f"older_than => TIMESTAMP '{older_than:%Y-%m-%d %H:%M:%S}')")
