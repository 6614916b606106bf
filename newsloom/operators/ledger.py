"""Budgets, rates and costs kept over event streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import running_sum


def sliding_rate(df: DataFrame, key: str, at_s: Column, window_s: int, limit: int) -> DataFrame:
    """The events with ``in_window``, how many of their key are at most ``window_s`` - 1 seconds old then, and ``wait_s`` until there is room again."""
    w = Window.partitionBy(key).orderBy(at_s).rangeBetween(-(window_s - 1), 0)
    n = F.count("*").over(w)
    return df.withColumn("in_window", n).withColumn("wait_s", F.when(n > limit, window_s - (at_s - F.min(at_s).over(w))).otherwise(0))


def fixed_windows(df: DataFrame, key: str, id_col: str, at_s: Column, window_s: int, limit: int) -> DataFrame:
    """(key, id, n, allowed, retry_s): windows of ``window_s`` seconds that begin with a key's first event after the last one ended.

    A window's start depends on the one before, so each key's events pass through a task in order;
    all that it holds of them is where the window began and how many were in it.
    """
    t = df.select(F.col(key).alias("k"), F.col(id_col).alias("i"), at_s.cast("long").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, n, begun = None, 0, 0, False
        for b in batches:
            ns, retries = [], []
            for k, at in zip(b.column("k").to_pylist(), b.column("at").to_pylist(), strict=True):
                if not begun or k != now or at - start >= window_s:
                    now, start, n, begun = k, at, 0, True
                n += 1
                ns.append(n)
                retries.append(max(1, start + window_s - at) if n > limit else 0)
            count = pa.array(ns, pa.int32())
            yield pa.record_batch([b.column("k"), b.column("i"), count, pa.compute.less_equal(count, limit), pa.array(retries, pa.int64())], names=["k", "i", "n", "allowed", "retry_s"])

    kinds = dict(t.dtypes)
    out = t.where("at IS NOT NULL").repartition("k").sortWithinPartitions("k", "at", "i").mapInArrow(run, f"k {kinds['k']}, i {kinds['i']}, n int, allowed boolean, retry_s long")
    return out.select(F.col("k").alias(key), F.col("i").alias(id_col), "n", "allowed", "retry_s")


def daily(df: DataFrame, at: Column, amount: Column, budget: float, *by: str) -> DataFrame:
    """By UTC day: events, the sum spent and what is left of the budget; a budget of 0 is endless (null left)."""
    spent = F.sum(F.coalesce(amount, F.lit(0.0)))
    left = F.greatest(F.lit(0.0), F.lit(float(budget)) - spent) if budget else F.lit(None).cast("double")
    return df.groupBy(F.to_date(at).alias("day"), *by).agg(F.count("*").alias("n"), spent.alias("spent"), left.alias("left"))


def running_spend(df: DataFrame, at: Column, id_col: str, amount: Column) -> DataFrame:
    """The events with the sum spent that day so far; a day may be any number of tasks."""
    return running_sum(df, "spent_so_far", F.to_date(at), F.coalesce(amount, F.lit(0.0)), at.asc(), F.col(id_col).asc())


def smoothed_cost(df: DataFrame, key: str, order: Column, amount: Column, start: int = 8500) -> DataFrame:
    """(key, cost, n): the moving estimate after each key's amounts in order, round(0.7 old + 0.3 new); amounts not above 0 leave it.

    The rounding at each step makes it a fold; a key's amounts pass through a task in order, and only
    the estimate is held.
    """
    t = df.where(amount > 0).select(F.col(key).alias("k"), order.alias("o"), amount.cast("double").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cost, n = None, start, 0
        for b in batches:
            done: list[tuple] = []
            kinds = [b.schema.field("k"), pa.field("cost", pa.int64()), pa.field("n", pa.int32())]
            for k, x in zip(b.column("k").to_pylist(), b.column("x").to_pylist(), strict=True):
                if n and k != now:
                    done.append((now, cost, n))
                    cost, n = start, 0
                now, cost, n = k, math.floor(cost * 0.7 + x * 0.3 + 0.5), n + 1
            if done:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), kinds, strict=True)], names=["k", "cost", "n"])
        if n:
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip((now, cost, n), kinds, strict=True)], names=["k", "cost", "n"])

    kind = dict(t.dtypes)["k"]
    out = t.repartition("k").sortWithinPartitions("k", "o", "x").mapInArrow(run, f"k {kind}, cost long, n int")
    return out.select(F.col("k").alias(key), "cost", "n")


def cooldown_s(retry_after: Column, body: Column) -> Column:
    """Seconds to wait after a refusal: what the header says, half an hour for a daily quota, what the text says; half a minute at least."""
    header = retry_after.try_cast("double")
    minutes = F.coalesce(F.regexp_extract(body, r"(?i)try again in\s+(?:(\d+)m)?([\d.]+)s", 1).try_cast("double"), F.lit(0.0))
    seconds = F.regexp_extract(body, r"(?i)try again in\s+(?:(\d+)m)?([\d.]+)s", 2).try_cast("double")
    daily_ = body.rlike(r"(?i)per[ -]day|(?<![A-Za-z0-9_])(?:RPD|TPD)(?![A-Za-z0-9_])")
    return F.when(header > 0, F.greatest(F.lit(30.0), header)).when(daily_, 1800.0).when(seconds.isNotNull(), F.greatest(F.lit(30.0), minutes * 60 + seconds)).otherwise(30.0)


def never_lower(spent: Column, body: Column) -> Column:
    """What counts as spent: the ledger's own sum, or the amount that a refusal names if that is greater."""
    return F.greatest(spent, F.coalesce(reported_usage(body), F.lit(0)))


def reported_usage(body: Column) -> Column:
    """The amount used that a refusal names, "Used 1234"; a ledger takes the greater of that and its own."""
    return F.regexp_extract(body, r"(?i)used[: ]+(\d+)", 1).try_cast("long")
