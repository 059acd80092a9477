"""Session defaults, the shared scratch folder and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast by hand only below this many bytes of payload.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024

# Removes the shuffle files of a job at its end (Spark 4.1; unknown settings are ignored).
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app: str = "opinarium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; a cluster
    without it is an error, because a machine-local folder would be lost with
    its executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can read")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="opinarium-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage for iterative jobs and survives the loss of executors. The shuffle
    files of the job go when it ends, as nothing but the table is read from then on.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def payload_bytes(df: DataFrame, *columns: Column) -> int:
    """Rows times 16 bytes plus the bytes of the given string columns."""
    width = F.lit(16).cast("long")
    for column in columns:
        width = width + F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    return df.agg(F.coalesce(F.sum(width), F.lit(0).cast("long"))).first()[0]


def broadcast_if_small(df: DataFrame, *columns: Column, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured payload fits; otherwise leave the
    choice of join to the optimizer, which splits skewed partitions."""
    return F.broadcast(df) if payload_bytes(df, *columns) <= limit else df
