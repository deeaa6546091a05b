"""Small file-system helpers over the Hadoop API, for any scheme Spark can read."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _handle(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _handle(spark, path)
    return fs.exists(hadoop)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder, empty when it does not exist."""
    hadoop, fs = _handle(spark, path)
    if not fs.exists(hadoop):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop))


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Promote a finished folder; fails when the target exists."""
    src, fs = _handle(spark, source)
    dst, _ = _handle(spark, target)
    if fs.exists(dst):
        return False
    fs.mkdirs(dst.getParent())
    return fs.rename(src, dst)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small driver-written file, such as a manifest."""
    hadoop, fs = _handle(spark, path)
    stream = fs.create(hadoop, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a loaded table is behind the path: the folder exists and holds something."""
    hadoop, fs = _handle(spark, path)
    return fs.exists(hadoop) and (fs.getFileStatus(hadoop).isFile() or len(child_names(spark, path)) > 0)
