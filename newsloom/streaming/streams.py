"""The same transforms over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..lineage import cut, drop, new_path
from ..operators.archive import upsert
from ..operators.dedup import BAND_S, greedy_alike
from ..ship import ship


def read_stream(spark: SparkSession, directory: str, name: str, files: int = 4) -> DataFrame:
    """A table's files as a stream; times without a zone are taken as UTC."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet")
    one = stream.option("recursiveFileLookup", "true").parquet(f"{directory}/{name}.parquet*")
    return one.select(*[F.col(f.name).cast("timestamp") if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema])


def windowed_counts(stream: DataFrame, at: str, every: str, *keys: str, slide: str | None = None, late: str = "1 hour", value: str | None = None) -> DataFrame:
    """Counts, and the sum of ``value``, by tumbling or sliding window and keys; rows later than ``late`` may be dropped."""
    w = F.window(at, every, slide) if slide else F.window(at, every)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", *(["total"] if value else []))


def without_repeats(stream: DataFrame, key: str, at: str, within: str = "2 hours") -> DataFrame:
    """The rows whose key was not seen within the given time before."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def first_hit_limit(stream: DataFrame, key: str, at: str, window_s: int, limit: int, keep: str = "1 hour") -> DataFrame:
    """(key, allowed, denied) by key and batch: windows begin with a key's first event; state goes when the watermark has passed it."""

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        allowed = denied = 0
        for t in sorted(t for p in parts for t in p[at].astype("int64") // 1_000_000_000):
            if start is None or t - start >= window_s:
                start, n = t, 0
            n += 1
            allowed += n <= limit
            denied += n > limit
        state.update((start, n))
        state.setTimeoutTimestamp(max(start + window_s, state.getCurrentWatermarkMs() // 1000 + 1) * 1000)
        yield pd.DataFrame({key: [name[0]], "allowed": [allowed], "denied": [denied]})

    ship(stream.sparkSession)
    kind = dict(stream.dtypes)[key]
    return stream.withWatermark(at, keep).select(key, at).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, allowed long, denied long", "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote; in complete mode, its last result."""
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def upsert_stream(stream: DataFrame, archive: DataFrame, key: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = 16) -> DataFrame:
    """The archive after all batches of a stream were merged into it.

    The archive lies in ``buckets`` buckets by key. A batch reads and writes those buckets only that
    it has keys of, each as a version named by the batch, so that a batch run again after a failure
    writes the same versions again.
    """
    spark = stream.sparkSession
    root, state = new_path(spark, "archive"), new_path(spark, "archive-state")
    in_bucket = lambda df: df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    in_bucket(archive).repartition("_b").write.partitionBy("_b").parquet(f"{root}/v-1")
    newest = dict.fromkeys(range(buckets), -1)

    def read(of: list[int]) -> DataFrame:
        files = [f"{root}/v{newest[b]}/_b={b}" for b in of]
        there = [f for f in files if _exists(spark, f)]
        return spark.read.schema(archive.schema).parquet(*there) if there else spark.createDataFrame([], archive.schema)

    def merge(df: DataFrame, n: int) -> None:
        batch = cut(in_bucket(prepare(df)), "batch")
        of = [r[0] for r in batch.select("_b").distinct().collect()]  # at most ``buckets``
        if not of:
            return
        after = upsert(read(of), batch.drop("_b"), key)
        in_bucket(after).repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{root}/v{n}")
        newest.update(dict.fromkeys(of, n))
        drop(batch)

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    return read(list(range(buckets)))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def without_alike(stream: DataFrame, id_col: str, title: str, at: str, band_s: int = BAND_S) -> DataFrame:
    """The rows of a stream whose headline is not alike that of a kept row before them within ``band_s`` seconds.

    Rows come before others by batch, and within a batch by time and id. A batch looks at the kept
    rows only that are near its own times.
    """
    spark = stream.sparkSession
    root, state = new_path(spark, "kept"), new_path(spark, "kept-state")
    done: list[int] = []

    def step(df: DataFrame, n: int) -> None:
        t = cut(df.select(F.col(id_col).alias("id"), F.col(title).alias("title"), F.unix_seconds(at).alias("at_s")), "batch")
        ends = t.agg(F.min("at_s").alias("a"), F.max("at_s").alias("b")).first()
        before = spark.read.schema(t.schema).parquet(*[f"{root}/{i}" for i in done if i < n]) if any(i < n for i in done) else t.limit(0)
        if ends["a"] is not None:
            before = before.where(F.col("at_s").between(ends["a"] - band_s, ends["b"] + band_s))
        both = t.withColumn("late", F.lit(1)).unionByName(before.withColumn("late", F.lit(0)))
        owners = greedy_alike(both, "id", F.col("title"), F.col("at_s"), F.col("late"), F.col("at_s"), band_s=band_s)
        t.join(owners.where("id = owner").select("id"), "id", "left_semi").write.mode("overwrite").parquet(f"{root}/{n}")
        if n not in done:
            done.append(n)

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return spark.read.schema(f"id {dict(stream.dtypes)[id_col]}, title string, at_s long").parquet(*[f"{root}/{i}" for i in sorted(done)]) if done else spark.createDataFrame([], f"id {dict(stream.dtypes)[id_col]}, title string, at_s long")


def refreshed(stream: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, every: str = "5 minutes") -> StreamingQuery:
    """A query that works ``make`` out anew for what has arrived, every so often; ``latest`` serves the last result meanwhile."""
    state = new_path(stream.sparkSession, "refresh-state")

    def step(df: DataFrame, n: int) -> None:
        make(df).write.mode("overwrite").parquet(f"{path}/{n}")

    return stream.writeStream.option("checkpointLocation", state).trigger(processingTime=every).foreachBatch(step).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last result of ``refreshed`` that was written whole."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = [int(f.getPath().getName()) for f in fs.listStatus(at) if _exists(spark, f"{path}/{f.getPath().getName()}/_SUCCESS")]
    return spark.read.parquet(f"{path}/{max(whole)}")
