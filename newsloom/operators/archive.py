"""The archive: upserts that never blank what they don't bring, and reads of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import CORE_COLUMNS, ENRICHED_COLUMNS, TOPICS


def split_for_write(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The enriched rows with all their columns, and the others with the core columns only; nulls of a column count, absent columns don't."""
    has = F.coalesce("enrichment_key", F.lit("")) != ""
    return items.where(has).select(*ENRICHED_COLUMNS), items.where(~has).select(*CORE_COLUMNS)


def upsert(archive: DataFrame, batch: DataFrame, key: str = "id", keep: tuple[str, ...] = ("first_seen_at",)) -> DataFrame:
    """The archive after the batch: matched rows take the batch's columns, but for ``keep``; new rows are added.

    Columns that the batch lacks stay as they are; a null that the batch brings is taken. Of equal
    keys in the batch the one last seen counts, of those the one whose hash is least. With first_seen_at among the archive's columns, new
    rows get their last_seen_at for it.
    """
    seen = [F.col("last_seen_at").desc_nulls_last()] if "last_seen_at" in batch.columns else []
    last = F.row_number().over(Window.partitionBy(key).orderBy(*seen, F.xxhash64(F.to_json(F.struct(*batch.columns)))))
    one = batch.withColumn("_n", last).where("_n = 1").drop("_n")
    a, b = archive.alias("a"), one.alias("b")
    new, both = F.col(f"a.{key}").isNull(), F.col(f"b.{key}").isNotNull()
    out: list[Column] = []
    for c in archive.columns:
        if c == key:
            out.append(F.coalesce(f"a.{key}", f"b.{key}").alias(key))
        elif c in one.columns and c not in keep:
            out.append(F.when(both, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        elif c == "first_seen_at" and "last_seen_at" in one.columns:
            out.append(F.when(new, F.col("b.last_seen_at")).otherwise(F.col("a.first_seen_at")).alias(c))
        else:
            out.append(F.col(f"a.{c}"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*out)


def record(archive: DataFrame, items: DataFrame) -> DataFrame:
    """The archive after both kinds of rows of ``items`` were written."""
    enriched, core = split_for_write(items)
    return upsert(upsert(archive, core), enriched)


def read_stories(archive: DataFrame) -> DataFrame:
    """Archive rows as stories, with a default for whatever a row lacks or has wrong."""
    at = F.coalesce("published_at", "first_seen_at", F.timestamp_seconds(F.lit(0)))
    return archive.select(
        "id", F.when(F.col("bucket") == "international", "international").otherwise("national").alias("bucket"), F.when(F.col("original_lang") == "en", "en").otherwise("np").alias("original_lang"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("source_url", F.lit("")).alias("source_url"), at.alias("published_at"), F.coalesce("summary", F.lit("")).alias("summary"), "title_translated", "summary_translated", "category",
        F.when(F.col("topic").isin(TOPICS), F.col("topic")).otherwise("society").alias("topic"), "image_url", "source_id", F.coalesce("source_name", "source_id").alias("source_name"), F.coalesce("credibility", F.lit(5)).alias("credibility"),
        F.greatest(F.lit(1), F.coalesce("coverage_count", F.lit(1))).alias("coverage_count"), F.when(F.size("alternate_source_ids") > 0, F.col("alternate_source_ids")).alias("alternate_source_ids"), "quality", "enrichment_key",
    )


def valid_id(c: Column) -> Column:
    return c.rlike("(?i)^[0-9a-f]{6,64}$")


def by_ids(archive: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The archive's rows of the well-formed ids; repeats don't multiply them."""
    return archive.join(ids.where(valid_id(F.col(column))).select(F.col(column).alias("id")).distinct(), "id", "left_semi")


def hydrate(pending: DataFrame, archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pending stories that the archive has under the same id and content key, with what it knows; and the rest."""
    known = archive.where("enrichment_key IS NOT NULL").select("id", "enrichment_key", F.col("summary").alias("stored_summary"), "title_translated", "summary_translated", "quality")
    both = ["id", "enrichment_key"]
    rest = pending.drop("title_translated", "summary_translated", "quality")
    return rest.join(known, both), rest.join(known, both, "left_anti")


def live_or_archive(live: DataFrame, archive: DataFrame, columns: list[str]) -> DataFrame:
    """Each id once: the live row if there is one, else the archive's."""
    both = live.select(*columns, F.lit(0).alias("_p")).unionByName(archive.select(*columns, F.lit(1).alias("_p")))
    n = F.row_number().over(Window.partitionBy("id").orderBy("_p"))
    return both.withColumn("_n", n).where("_n = 1").withColumn("origin", F.when(F.col("_p") == 0, "live").otherwise("archive")).drop("_n", "_p")


def shares(archive: DataFrame) -> DataFrame:
    """(check, n, share): how much of the archive is translated, pictured, summarised and so on."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    checks = {"rows": F.lit(True), "summary": has("summary"), "image": has("image_url"), "translated": has("title_translated") & has("summary_translated"), "dated": F.col("published_at").isNotNull(), "covered twice": F.coalesce("coverage_count", F.lit(1)) > 1}
    sums = archive.agg(*[F.count_if(v).alias(k) for k, v in checks.items()])
    named = sums.select(F.col("rows").alias("all"), F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in checks]), F.array(*[F.col(k) for k in checks]))).alias("check", "n"))
    return named.select("check", "n", F.when(F.col("all") > 0, F.floor(F.col("n") * 100 / F.col("all") + 0.5)).otherwise(0).cast("long").alias("share"))


def longest_by(df: DataFrame, key: str, text: str, id_col: str = "id") -> DataFrame:
    """The row with the longest text of each key, the least id of equals."""
    n = F.coalesce(F.length(text), F.lit(0))
    return df.groupBy(key).agg(F.min_by(F.col(id_col), F.struct((-n).alias("n"), F.col(id_col).alias("i"))).alias(id_col), F.max(n).alias("length"))


def counted(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """The rows, and counters over them (conditions) that are filled in as the rows are written, without a pass of their own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counters.items()]), seen
