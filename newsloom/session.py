"""A Spark session with the settings the operators assume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans, skew joins; further settings as keyword arguments with '__' for '.'."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def spread(table: DataFrame) -> DataFrame:
    """A table that lies in fewer pieces than there are cores, dealt out over them; any other as it is.

    For plain scans only, before work that is heavy for each row.
    """
    n = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(n) if table.rdd.getNumPartitions() < n else table
