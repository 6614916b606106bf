"""Schemas of the entities, and the rules that a table of them has to keep."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUALITY = "struct<audited: boolean, bilingual: boolean, verified: boolean, note: string>"
RAW_STORY = "title string, url string, description string, pub_date string, image_url string, guid string"
SOURCE = "id string, name string, bucket string, country string, language string, categories array<string>, rss_url string, homepage_url string, priority int, active boolean, note string, url_prefix string, credibility_score int"
CORE_COLUMNS = ["id", "source_url", "source_id", "source_name", "title", "summary", "original_lang", "bucket", "topic", "category", "credibility", "image_url", "published_at", "last_seen_at", "coverage_count", "alternate_source_ids"]
ENRICHED_COLUMNS = [*CORE_COLUMNS, "title_translated", "summary_translated", "enrichment_key", "quality"]
ARTICLE = f"id string, source_url string, source_id string, source_name string, title string, summary string, original_lang string, title_translated string, summary_translated string, bucket string, topic string, category string, credibility int, image_url string, published_at timestamp, first_seen_at timestamp, last_seen_at timestamp, coverage_count int, alternate_source_ids array<string>, canonical_id string, enrichment_key string, quality {QUALITY}"
SUBSCRIBER = "id long, email string, language string, status string, requested_at timestamp, confirmed_at timestamp, unsubscribed_at timestamp, source_ip string, user_agent string"
SUBSCRIPTION_EVENT = "id long, subscriber_id long, event string, at timestamp, detail string"
DELIVERY = "digest_date date, subscriber_id long, status string, attempted_at timestamp, error string"
FINDINGS = "array<struct<code: string, severity: string, detail: string>>"

#: The enumerations.
TOPICS = ["breaking", "politics", "business", "technology", "health", "environment", "society", "sports", "world"]
BUCKETS = ["national", "international"]
LANGS = ["en", "np"]
STATUSES = ["pending", "confirmed", "unsubscribed"]
DELIVERY_STATUSES = ["sending", "sent", "failed"]


def violations(df: DataFrame, key: str | list[str], not_null: Iterable[str] = (), one_of: dict[str, list[str]] | None = None, refers: Iterable[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """(rule, key, n): rows that break a rule, one row for each rule and key.

    Rules are: a column is null, a value is none of those allowed (null is fine), the key is not
    unique, a value refers to no row of another table (null is fine).
    """
    keys = [key] if isinstance(key, str) else key
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    checks: list[Column] = [F.when(F.col(c).isNull(), F.lit(f"not_null:{c}")) for c in not_null]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(values), F.lit(f"one_of:{c}")) for c, values in (one_of or {}).items()]
    rows = df.select(name.alias("key"), F.explode(F.array_compact(F.array(*checks, F.lit(None).cast("string")))).alias("rule"))
    out = rows.groupBy("rule", "key").agg(F.count("*").alias("n"))
    twice = df.groupBy(name.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("unique").alias("rule"), "key", "n")
    out = out.unionByName(twice)
    for column, table, to in refers:
        other = table.select(F.col(to).alias(column)).distinct()
        lost = df.where(F.col(column).isNotNull()).join(other, column, "left_anti")
        out = out.unionByName(lost.groupBy(name.alias("key")).agg(F.count("*").alias("n")).select(F.lit(f"refers:{column}").alias("rule"), "key", "n"))
    return out
