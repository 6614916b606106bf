"""Newsworthiness, and the selections made by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import numbered

#: Weights of the score's parts, and the hours after which freshness has halved.
COVERAGE, CREDIBILITY, FRESHNESS, BREAKING, HALF_LIFE_H = 40.0, 3.0, 45.0, 20.0, 12.0


def score(coverage: Column, credibility: Column, at_s: Column, topic: Column, now_s: Column) -> Column:
    """How newsworthy a story is; times in seconds, future ones count as now."""
    age_h = F.greatest(F.lit(0.0), (now_s - at_s) / 3600.0)
    return F.log2(coverage + F.lit(1.0)) * COVERAGE + credibility * CREDIBILITY + F.pow(F.lit(0.5), age_h / HALF_LIFE_H) * FRESHNESS + F.when(topic == "breaking", BREAKING).otherwise(0.0)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """All rows with their ``rank`` in the order, from 1."""
    return numbered(df, "_n", *order).withColumn("rank", F.col("_n") + 1).drop("_n")


def top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(max(0, limit))


def top_of_each(df: DataFrame, key: str, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def trending(df: DataFrame, limit: int, *order: Column, per_source: int = 2) -> DataFrame:
    """The best ``limit`` rows with at most ``per_source`` of one outlet, filled up by rank if that leaves too few.

    Only the first ``limit`` rows of an outlet can be in it, so the windows' result is cut to those
    before the rest is sorted.
    """
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(*order))
    few = df.withColumn("_n", n).where(F.col("_n") <= limit)
    return few.orderBy((F.col("_n") > per_source).cast("int"), *order).limit(limit).drop("_n")


def ticker(df: DataFrame, at_s: Column, now_s: Column, limit: int = 8, hours: int = 12) -> DataFrame:
    """Stories under ``hours`` old: breaking or covered more than once first, then the newest."""
    urgent = (F.col("topic") == "breaking") | (F.col("coverage_count") > 1)
    return df.where(now_s - at_s < hours * 3600).orderBy(F.coalesce(urgent, F.lit(False)).cast("int").desc(), at_s.desc_nulls_last(), F.col("id")).limit(limit)


def digest(df: DataFrame, at_s: Column, most: int) -> DataFrame:
    """The day's picks with their section: by coverage, then time, then id; cut before they are divided by bucket."""
    return df.orderBy(F.col("coverage_count").desc(), at_s.desc_nulls_last(), F.col("id")).limit(max(0, most)).withColumn("section", F.when(F.col("bucket") == "national", "national").otherwise("international"))


def related(df: DataFrame, id_: str, topic: str, at_s: Column, limit: int = 6) -> DataFrame:
    """Other stories, of the same topic first."""
    return df.where(F.col("id") != id_).orderBy((~F.col("topic").eqNullSafe(topic)).cast("int"), at_s.desc_nulls_last(), F.col("id")).limit(limit)


def page(df: DataFrame, number: int, size: int, total: int, *order: Column) -> DataFrame:
    """Page ``number`` of the ordered rows, kept within the pages there are."""
    pages = max(1, -(-total // size))
    return df.orderBy(*order).offset((min(max(1, number), pages) - 1) * size).limit(size)


def page_numbers(current: int, pages: int) -> list[int | None]:
    """The numbers a pager shows: the ends, the neighbours of the current page, None for a gap."""
    shown = sorted({1, pages, *range(max(1, current - 1), min(pages, current + 1) + 1)} if pages > 7 else set(range(1, pages + 1)))
    out: list[int | None] = []
    for n in shown:
        if out and n - (out[-1] or 0) > 1:
            out.append(None)
        out.append(n)
    return out


def diversify(df: DataFrame, limit: int, *order: Column, lookahead: int = 14) -> DataFrame:
    """(pos, id): the first ``limit`` rows in order, moved so that neighbours are of different outlets where one of the next ``lookahead`` allows.

    A selection of at most ``limit`` rows, which meet in one row.
    """
    n = F.row_number().over(Window.orderBy(*order))
    ordered = df.orderBy(*order).limit(limit).select(n.alias("n"), "id", "source_id")
    pool = ordered.agg(F.array_sort(F.collect_list(F.struct("n", "id", "source_id"))).alias("pool"))
    kind = "array<struct<n: int, id: string, source_id: string>>"
    start = F.struct(F.col("pool").cast(kind).alias("pool"), F.array().cast(kind).alias("out"))

    def step(a: Column, _: Column) -> Column:
        last = F.element_at(a["out"], -1)["source_id"]
        near = F.slice(a["pool"], 1, lookahead)
        other = F.get(F.filter(near, lambda x: x["source_id"] != last), F.lit(0))
        head = F.get(a["pool"], F.lit(0))
        pick = F.when((F.size(a["out"]) == 0) | (head["source_id"] != last) | other.isNull(), head).otherwise(other)
        return F.struct(F.filter(a["pool"], lambda x: x["n"] != pick["n"]).alias("pool"), F.concat(a["out"], F.array(pick)).alias("out"))

    out = pool.where(F.size("pool") > 0).select(F.aggregate(F.sequence(F.lit(1), F.size("pool")), start, step)["out"].alias("out"))
    return out.select(F.posexplode("out").alias("pos", "x")).select((F.col("pos") + 1).alias("pos"), "x.id", "x.source_id")
