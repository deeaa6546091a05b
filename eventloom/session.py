"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    # Event times are UTC wall clocks; every date and hour function relies on it.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "eventloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> None:
    """The data model stores UTC wall clocks, so the session must read them as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local master, where driver and executors are one process, gets a
    temporary folder when the setting is missing.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
    path = tempfile.mkdtemp(prefix="eventloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path in the shared folder; each call gets its own."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later reads see these exact rows, also after executor loss."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


class _Blocks(threading.local):
    """Folders written by ``stage_once`` inside a thread's open ``passing_stages`` blocks, the innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_BLOCKS = _Blocks()


@contextmanager
def passing_stages(spark: SparkSession) -> Iterator[None]:
    """Remove what ``stage_once`` wrote in the block when it ends, so that disk holds one step's tables at a time.

    Whatever is needed later must be staged after the block, or inside it by ``stage_once(..., keep=True)``.
    """
    _BLOCKS.open.append([])
    try:
        yield
    finally:
        for path in _BLOCKS.open.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage_once(df: DataFrame, name: str, keep: bool = False, compression: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back, its size then known.

    ``keep`` leaves it to the block around the innermost ``passing_stages``, if there is one. ``compression`` names
    the Parquet codec, else the session's is taken.
    """
    path = scratch_path(df.sparkSession, name)
    block = len(_BLOCKS.open) - (2 if keep else 1)
    if block >= 0:
        _BLOCKS.open[block].append(path)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
