"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every job relies on. Everything else (executors, memory, shuffle
# partitions) belongs to the cluster.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# A row of an already closed window is dropped in the very batch it arrives in, as the
# jobs hold a single stateful operator each. State lives off-heap and is spilled to disk.
# Sessions are merged within each input partition ahead of the shuffle.
STREAM_CONF = {
    **REQUIRED_CONF,
    "spark.sql.streaming.statefulOperator.allowMultiple": "false",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "streamlake", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the results depend on to a session somebody else created."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def streaming_session(spark: SparkSession) -> SparkSession:
    """A sibling session on the same context, so stream settings do not leak to the caller."""
    sibling = spark.newSession()
    for key, value in STREAM_CONF.items():
        sibling.conf.set(key, value)
    sibling.conf.set("spark.sql.shuffle.partitions",
                     spark.conf.get("spark.sql.shuffle.partitions"))
    return sibling


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="streamlake-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def run_dir(spark: SparkSession, job: str) -> str:
    """A fresh folder for one run of a job below the shared folder."""
    return f"{shared_dir(spark)}/streamlake/{job}-{uuid.uuid4().hex}"
