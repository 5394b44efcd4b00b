"""Session building and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def build_session(app: str = "tickloom", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session with adaptive execution on and UTC time; a cluster sets its own master."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("TICKLOOM_DRIVER_MEMORY", "12g"))
        b = b.config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
        # small test data: keep all local cores busy instead of merging into one task
        b = b.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; a cluster without the
    setting is an error, because a machine-local folder does not survive a lost executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tickloom-")
    return _OWN[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, but keeps column pruning, filter
    push-down and size statistics for what follows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
