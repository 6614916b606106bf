"""Places and running sums in one order of all rows, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut

_INDEX = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


def _ranges(df: DataFrame, order: tuple[Column, ...]) -> DataFrame:
    """The rows dealt into ranges of the order, with the range's number ``_p`` and the place in it ``_i``; written out, as another run may draw other ranges."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(dealt.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit(_INDEX))), "ranges")


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """The rows with their place in the order, from 0; the order should be total.

    Rows are numbered within ranges of the order; a range begins where those before it end, and only
    the ranges' sizes meet in one place.
    """
    dealt = _ranges(df, order)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    return dealt.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def running_sum(df: DataFrame, name: str, key: Column, amount: Column, *order: Column) -> DataFrame:
    """The rows with the sum of ``amount`` of their key up to them; a key's rows may be spread over any number of ranges."""
    dealt = _ranges(df.withColumn("_k", key).withColumn("_x", amount), (F.col("_k").asc(), *order))
    within = Window.partitionBy("_p", "_k").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_p", "_k").agg(F.sum("_x").alias("_c")).select("_p", F.col("_k").alias("_j"), F.coalesce(F.sum("_c").over(before), F.lit(0.0)).alias("_s"))
    out = dealt.withColumn("_w", F.sum("_x").over(within)).alias("d").join(starts.alias("s"), (F.col("d._p") == F.col("s._p")) & F.col("d._k").eqNullSafe(F.col("s._j")))
    return out.withColumn(name, F.col("_s") + F.col("_w")).select(*df.columns, name)
