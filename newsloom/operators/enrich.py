"""Enrichment by a model: what is sent, what comes back, and what of it is kept."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import audit
from ..functions import text as tx
from ..ship import ship
from .order import numbered


class Enricher(Protocol):
    """Answers a batch of stories (id, title, summary, original_lang) with summary, title_translated and summary_translated."""

    def __call__(self, stories: pd.DataFrame) -> pd.DataFrame: ...


def echo_enricher(stories: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a model: the same input always gives the same answer, and no network is needed."""
    return pd.DataFrame({"id": stories["id"], "summary": stories["summary"].str.strip(), "title_translated": "[" + stories["title"].fillna("") + "]", "summary_translated": "[" + stories["summary"].fillna("") + "]"})


def route(df: DataFrame, cached: DataFrame) -> DataFrame:
    """The rows with ``route``: blank (no text, or a subscription pitch), cached (its content key is known) or pending."""
    known = cached.select("enrichment_key").where("enrichment_key IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    blank = (F.coalesce("summary", F.lit("")) == "") | tx.is_boilerplate(F.col("summary"))
    return df.join(known, "enrichment_key", "left").withColumn("route", F.when(blank, "blank").when(F.col("_hit"), "cached").otherwise("pending")).drop("_hit")


def batches(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """The rows with batch_no and place, in order: ``size`` rows to a batch. They are numbered by ranges, no task holds them all."""
    return numbered(df, "_n", *order).withColumn("batch_no", F.floor(F.col("_n") / size).cast("int")).withColumn("place", (F.col("_n") % size).cast("int")).drop("_n")


def affordable(df: DataFrame, per_pass: int, tokens_left: int, tokens_each: int) -> DataFrame:
    """The batches that a pass may send: at most ``per_pass``, and as many as the tokens left pay for."""
    return df.where(F.col("batch_no") < max(0, min(per_pass, tokens_left // max(1, tokens_each))))


def ask(df: DataFrame, enricher: Enricher = echo_enricher) -> DataFrame:
    """The answers of an enricher to the stories, batch by batch in the tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield enricher(part)[["id", "summary", "title_translated", "summary_translated"]]

    ship(df.sparkSession)
    return df.select("id", "title", "summary", "original_lang").mapInPandas(run, "id string, summary string, title_translated string, summary_translated string")


def pair_replies(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """(batch_no, id, reply): the first reply to a story by its id; stories without one take the reply at their place, if that names no story.

    ``asked`` has batch_no, place and id, ``replies`` batch_no, place, id and reply.
    """
    n = F.row_number().over(Window.partitionBy("batch_no", "id").orderBy("place"))
    named = replies.where("id IS NOT NULL").withColumn("_n", n).where("_n = 1").select("batch_no", "id", F.col("reply").alias("by_id"))
    loose = replies.join(asked.select("batch_no", "id"), ["batch_no", "id"], "left_anti").select("batch_no", "place", F.col("reply").alias("by_place"))
    out = asked.join(named, ["batch_no", "id"], "left").join(loose, ["batch_no", "place"], "left")
    return out.select("batch_no", "id", F.coalesce("by_id", "by_place").alias("reply"))


def apply(df: DataFrame, answers: DataFrame) -> DataFrame:
    """The stories with what passes the audit: a rewritten summary, and a translation if both its halves are there and sound."""
    a = answers.select("id", F.col("summary").alias("_s"), F.col("title_translated").alias("_tt"), F.col("summary_translated").alias("_st"))
    other = F.when(F.col("original_lang") == "en", "np").otherwise("en")
    good = F.coalesce(audit.is_ok(audit.findings(F.col("_s"), F.col("original_lang"), F.col("title"))), F.lit(False)) & F.col("_s").isNotNull()
    whole = (F.coalesce("_tt", F.lit("")) != "") & (F.coalesce("_st", F.lit("")) != "")
    sound = whole & audit.is_ok(audit.story_findings(F.col("_tt"), F.col("_st"), other))
    t = df.drop("title_translated", "summary_translated").join(a, "id", "left")
    t = t.withColumn("_sound", F.coalesce(sound, F.lit(False))).withColumn("_good", good)
    out = t.withColumn("summary", F.when(F.col("_good"), F.col("_s")).otherwise(F.col("summary"))).withColumn("title_translated", F.when(F.col("_sound"), F.col("_tt"))).withColumn("summary_translated", F.when(F.col("_sound"), F.col("_st")))
    return out.withColumn("quality", F.struct(F.lit(True).alias("audited"), F.col("_sound").alias("bilingual"), F.lit(None).cast("boolean").alias("verified"), F.lit(None).cast("string").alias("note"))).drop("_s", "_tt", "_st", "_sound", "_good")


def cap_summaries(df: DataFrame) -> DataFrame:
    """Summaries that no model has written, cut to the language's bound."""
    _, most = tx.summary_bounds(F.col("original_lang"))
    cut = F.when(most == 1210, tx.hard_truncate(F.col("summary"), 1210)).otherwise(tx.hard_truncate(F.col("summary"), 1100))
    return df.withColumn("summary", F.when(F.coalesce("enrichment_key", F.lit("")) == "", cut).otherwise(F.col("summary")))


def merge_verdicts(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The stories with verified set from (id, summary_ok, translation_ok); no verdict leaves it, a bad translation is withdrawn.

    A verdict that does not say false says true.
    """
    v = verdicts.select("id", F.coalesce("summary_ok", F.lit(True)).alias("_s"), F.coalesce("translation_ok", F.lit(True)).alias("_t"), F.lit(True).alias("_v"))
    t = df.join(v, "id", "left")
    bad = F.coalesce(~F.col("_t"), F.lit(False))
    q = F.struct(F.col("quality.audited").alias("audited"), F.when(bad, False).otherwise(F.col("quality.bilingual")).alias("bilingual"), F.when(F.col("_v"), F.col("_s") & F.col("_t")).otherwise(F.col("quality.verified")).alias("verified"), F.col("quality.note").alias("note"))
    for c in ("title_translated", "summary_translated"):
        t = t.withColumn(c, F.when(bad, F.lit(None)).otherwise(F.col(c)))
    return t.withColumn("quality", q).drop("_s", "_t", "_v")


def verify_candidates(df: DataFrame) -> DataFrame:
    """The stories that a second look is due for: bilingual, with a translation, and without a verdict so far."""
    return df.where(F.coalesce("quality.bilingual", F.lit(False)) & (F.coalesce("summary_translated", F.lit("")) != "") & F.col("quality.verified").isNull())


def carry_verdicts(df: DataFrame, earlier: DataFrame) -> DataFrame:
    """The stories with the verdict, and its note, that ``earlier`` (id, quality) has of them, where the audit has passed again: those with a quality."""
    old = earlier.where("quality.verified IS NOT NULL").select("id", F.col("quality.verified").alias("_v"), F.col("quality.note").alias("_n"))
    known = F.col("_v").isNotNull()
    q = F.struct(F.col("quality.audited").alias("audited"), F.col("quality.bilingual").alias("bilingual"), F.when(known, F.col("_v")).otherwise(F.col("quality.verified")).alias("verified"), F.when(known, F.col("_n")).otherwise(F.col("quality.note")).alias("note"))
    return df.join(old, "id", "left").withColumn("quality", F.when(F.col("quality").isNotNull(), q)).drop("_v", "_n")


def default_verdicts(df: DataFrame) -> DataFrame:
    """The stories with a quality each: those that no audit has seen count as audited, and as bilingual if they have a translation."""
    unseen = F.struct(F.lit(True).alias("audited"), (F.coalesce("summary_translated", F.lit("")) != "").alias("bilingual"), F.lit(None).cast("boolean").alias("verified"), F.lit(None).cast("string").alias("note"))
    return df.withColumn("quality", F.when(F.col("quality").isNull(), unseen).otherwise(F.col("quality")))


def proper_nouns(c: Column) -> Column:
    """The different capitalised words of Latin letters, of three letters at least."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]{2,})(?![A-Za-z0-9_])"), F.lit(1)))


def names_kept(source: Column, target: Column, from_lang: Column) -> Column:
    """The share of an English source's names that stand in the translation as they are; null for other languages, where names are written anew."""
    said = proper_nouns(source)
    kept = F.size(F.filter(said, lambda w: F.contains(F.coalesce(target, F.lit("")), w)))
    return F.when(from_lang == "en", F.when(F.size(said) == 0, 1.0).otherwise(kept / F.size(said)))


def fidelity(df: DataFrame, source: Column, target: Column, lang: Column) -> DataFrame:
    """The rows with figures kept, script right and relative length of a translation; ``names_kept`` tells of names."""
    digits = lambda c: F.translate(c, "०१२३४५६७८९", "0123456789")
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(digits(F.coalesce(c, F.lit(""))), F.lit(r"(\d+(?:[.,]\d+)*)"), F.lit(1)))
    have, got = numbers(source), numbers(target)
    kept = F.when(F.size(have) == 0, 1.0).otherwise(F.size(F.array_intersect(have, got)) / F.size(have))
    d, l, n = tx.script_counts(F.coalesce(target, F.lit("")))
    right = F.when(n == 0, 0.0).otherwise(F.when(lang == "np", d).otherwise(l) / n)
    return df.withColumn("numbers_kept", kept).withColumn("script_share", right).withColumn("length_ratio", F.when(F.length(source) > 0, F.length(target) / F.length(source)))
