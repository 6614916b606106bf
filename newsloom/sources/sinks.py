"""What leaves the engine: sitemaps, structured data, JSON, digest texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_markup, truncate


def news_sitemap(df: DataFrame, at_s: Column, now_s: Column, site: str, name: str, hours: int = 48, limit: int = 1000) -> DataFrame:
    """(id, entry): the entries of a news sitemap, newest first."""
    x = lambda c: escape_markup(c, "&apos;")
    stamp = F.date_format(F.timestamp_seconds(at_s), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    entry = F.concat(
        F.lit(f"<url><loc>{site}/story/"), F.col("id"), F.lit(f"</loc><news:news><news:publication><news:name>{name}</news:name><news:language>"), F.when(F.col("original_lang") == "np", "ne").otherwise(F.col("original_lang")),
        F.lit("</news:language></news:publication><news:publication_date>"), stamp, F.lit("</news:publication_date><news:title>"), x(F.col("title")), F.lit("</news:title></news:news></url>"),
    )
    return df.where(at_s >= now_s - hours * 3600).orderBy(at_s.desc(), F.col("id")).limit(limit).select("id", entry.alias("entry"))


def sitemap(df: DataFrame, at_s: Column, site: str, limit: int = 2000) -> DataFrame:
    """(loc, changed_s): the newest stories' addresses."""
    return df.orderBy(at_s.desc_nulls_last(), F.col("id")).limit(limit).select(F.concat(F.lit(f"{site}/story/"), F.col("id")).alias("loc"), at_s.alias("changed_s"))


def structured_data(df: DataFrame, at_s: Column) -> DataFrame:
    """(id, json): a schema.org NewsArticle for each story."""
    doc = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.col("title").alias("headline"), truncate(F.col("summary"), 200).alias("description"), at_s.alias("datePublished"), F.col("source_name").alias("publisher"), F.col("source_url").alias("isBasedOn")))
    return df.select("id", doc.alias("json"))


def as_json(df: DataFrame) -> DataFrame:
    """(json): each row as a JSON object; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def digest_lines(df: DataFrame, site: str) -> DataFrame:
    """(section, id, line): a digest's stories as plain text."""
    outlets = F.when(F.col("coverage_count") > 1, F.concat(F.lit(" ("), F.col("coverage_count").cast("string"), F.lit(" outlets)"))).otherwise("")
    return df.select("section", "id", F.concat(F.col("title"), F.lit(" — "), F.col("source_name"), outlets, F.lit("\n"), truncate(F.coalesce("summary", F.lit("")), 220), F.lit(f"\n{site}/story/"), F.col("id")).alias("line"))
