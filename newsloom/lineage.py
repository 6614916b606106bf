"""Where intermediate tables go, so that a lost executor costs a re-read and not a re-run."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is unset and all tasks run in this process, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/newsloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The same rows, read back from a table written to the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._newsloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the tables of ``cut`` that nothing will read any more; other tables are left alone."""
    for t in tables:
        path = getattr(t, "_newsloom_path", None)
        if path:
            delete(t.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session is gone already; the folder is the cluster's to empty
            return
