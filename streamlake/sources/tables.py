"""Lake table scans and namespace handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Expose tables by name to SQL and BI readers."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def ensure_table(spark: SparkSession, namespace: str, table: str, columns: str,
                 fmt: str = "parquet", properties: dict[str, str] | None = None) -> None:
    """Create the namespace and the table unless they exist; existing data is left alone."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {namespace}")
    options = ""
    if properties:
        pairs = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
        options = f" TBLPROPERTIES ({pairs})"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {namespace}.{table} ({columns}) USING {fmt}{options}")


def rest_catalog_conf(catalog: str, uri: str, warehouse: str,
                      s3_endpoint: str | None = None) -> dict[str, str]:
    """Session settings that mount an Iceberg REST catalog (needs the Iceberg runtime jar)."""
    prefix = f"spark.sql.catalog.{catalog}"
    conf = {
        prefix: "org.apache.iceberg.spark.SparkCatalog",
        f"{prefix}.type": "rest",
        f"{prefix}.uri": uri,
        f"{prefix}.warehouse": warehouse,
    }
    if s3_endpoint:
        conf[f"{prefix}.io-impl"] = "org.apache.iceberg.aws.s3.S3FileIO"
        conf[f"{prefix}.s3.endpoint"] = s3_endpoint
        conf[f"{prefix}.s3.path-style-access"] = "true"
    return conf


def read_relational(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
                    partitions: int, properties: dict[str, str] | None = None) -> DataFrame:
    """Snapshot of an operational table, read in parallel key ranges over JDBC."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})
