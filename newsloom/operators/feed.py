"""The feed: normalised stories, filters, counts and what a client gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import url as ul
from ..functions.classify import is_breaking, with_topic
from ..functions.html import to_text
from .order import numbered

#: Days of the ranges a reader can ask for, hours for which a marked story is breaking, an outlet's credibility if unset.
RANGES = {"day": 1, "week": 7, "month": 30}
BREAKING_H, CREDIBILITY = 3, 5
#: Columns that a client does not get.
PRIVATE = ["quality", "enrichment_key", "canonical_id", "first_seen_at", "last_seen_at"]
#: Rows of the source dimension up to which it is broadcast.
SOURCE_ROWS = 50_000


def source_dim(sources: DataFrame) -> DataFrame:
    """The outlets, with a broadcast hint if they were counted and are few."""
    return F.broadcast(sources) if sources.limit(SOURCE_ROWS + 1).count() <= SOURCE_ROWS else sources


def active(sources: DataFrame) -> DataFrame:
    return sources.where("active AND rss_url IS NOT NULL")


def by_priority(sources: DataFrame) -> DataFrame:
    """The outlets in the order in which they are fetched: by priority, then id; with their ``place``, from 0."""
    return numbered(sources, "place", F.col("priority").desc_nulls_last(), F.col("id").asc())


def of_topic(df: DataFrame, topic: str) -> DataFrame:
    """Rows of a topic; "all" filters nothing."""
    return df if topic == "all" else df.where(F.col("topic") == topic)


def with_summary(df: DataFrame) -> DataFrame:
    """Rows with any body text."""
    return df.where(F.coalesce("summary", F.lit("")) != "")


def valid_stories(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Feed records with a headline and an address, of known outlets, below the outlet's address prefix if it has one."""
    s = source_dim(sources.select(F.col("id").alias("source_id"), "url_prefix"))
    good = (F.length("title") > 2) & (F.length("url") > 5)
    kept = F.col("url_prefix").isNull() | (F.col("url_prefix") == "") | F.col("url").startswith(F.col("url_prefix"))
    return raw.where(good).join(s, "source_id").where(kept).drop("url_prefix")


def normalize(raw: DataFrame, sources: DataFrame, now_s: Column | None = None) -> DataFrame:
    """Feed records as stories; ``now_s`` is the time that stands for missing and future dates, by default that of the fetch.

    Every record of a known outlet has one row; null titles and descriptions count as empty.
    """
    s = source_dim(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "bucket", F.col("language").alias("original_lang"), "categories", F.coalesce("credibility_score", F.lit(CREDIBILITY)).alias("credibility"), "priority"))
    t = raw.join(s, "source_id")
    now = now_s if now_s is not None else F.unix_timestamp(F.col("fetched_at").cast("timestamp"))
    at = F.least(F.coalesce(ul.parse_date(F.col("pub_date")), ul.date_in_url(F.col("url")), now), now)
    t = t.withColumn("now", now).withColumn("published_s", at).withColumn("clean_title", to_text(F.coalesce("title", F.lit("")))).withColumn("body", to_text(F.coalesce("description", F.lit(""))))
    t = t.withColumn("summary", tx.standfirst(F.col("clean_title"), F.col("body")))
    fresh = (F.col("now") - F.col("published_s") < BREAKING_H * 3600) & is_breaking(F.col("clean_title"))
    t = with_topic(t, "topic", F.col("clean_title"), F.col("summary"), F.col("categories"))
    return t.select(
        ul.fingerprint(F.col("url")).alias("id"), "raw_id", "bucket", "original_lang", F.col("clean_title").alias("title"), F.col("url").alias("source_url"), "published_s", "summary", F.get("categories", F.lit(0)).alias("category"),
        F.when(fresh, "breaking").otherwise(F.col("topic")).alias("topic"), ul.clean_image(F.col("image_url")).alias("image_url"), "source_id", "source_name", "credibility", "priority", F.lit(1).alias("coverage_count"),
    )


def in_range(df: DataFrame, at_s: Column, now_s: Column, name: str) -> DataFrame:
    if name not in RANGES:
        raise ValueError(f"no such range: {name}")
    return df.where(at_s >= now_s - RANGES[name] * 86_400)


def in_bucket(df: DataFrame, bucket: str | None) -> DataFrame:
    """Rows of a bucket; a name that is none filters nothing."""
    return df.where(F.col("bucket") == bucket) if bucket in ("national", "international") else df


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows whose headline, summary or outlet holds the query, whatever the case; an empty query filters nothing."""
    q = query.strip().lower()
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("source_name", F.lit(""))))
    return df.where(F.contains(hay, F.lit(q))) if q else df


def topic_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("topic").agg(F.count("*").alias("n"))


def available_topics(df: DataFrame, order: list[str]) -> DataFrame:
    """(topic, n, place) of the topics that have stories, in display order."""
    place = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("topic"))
    return topic_counts(df.where(F.col("topic").isin(order))).withColumn("place", place.cast("int"))


def client_items(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """What a client gets: the first ``limit`` rows without the private columns."""
    return df.orderBy(*order).limit(max(0, limit)).drop(*PRIVATE)


def source_status(raw: DataFrame, sources: DataFrame, kept: DataFrame) -> DataFrame:
    """By active outlet: records fetched, stories kept, and whether there are any."""
    got = raw.groupBy("source_id").agg(F.count("*").alias("fetched"))
    left = kept.groupBy("source_id").agg(F.count("*").alias("kept"))
    s = active(sources).select(F.col("id").alias("source_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return s.join(got, "source_id", "left").join(left, "source_id", "left").select("source_id", zero(F.col("fetched")).alias("fetched"), zero(F.col("kept")).alias("kept"), (zero(F.col("fetched")) > 0).alias("ok"))
