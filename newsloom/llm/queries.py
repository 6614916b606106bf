"""Queries pN_... of the problems of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import forms, history, leaks, neardup, packing, residue, subjects, truncation
from .lineage import cut

#: The container kind that p6_pack fills.
CONTAINER = 3


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name in ("raw_stories", "articles", "documents") else df


def _residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_rows(residue.feed_texts(_t(spark, d, "raw_stories"), _t(spark, d, "articles")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.changed_fields(_t(spark, d, "articles"), _residue(spark, d))


def p2_one_form(spark: SparkSession, d: str) -> DataFrame:
    """All articles' titles and summaries in one form."""
    out = forms.to_one_form(_t(spark, d, "articles").select(F.col("id").alias("article_id"), "title", "summary"), ["title", "summary"])
    return out.select("article_id", "title", "summary", F.array_join("changed_fields", ",").alias("changed_fields"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    texts = neardup.news_texts(_t(spark, d, "articles"), cut(_residue(spark, d), "residue"))
    return neardup.near_duplicate_pairs(texts, "id", ["title", "summary"], k=3, threshold=0.5)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """The articles that tell the same story, by groups, at the same similarity as p3_found."""
    texts = neardup.news_texts(_t(spark, d, "articles"), cut(_residue(spark, d), "residue"))
    return neardup.near_duplicate_groups(texts, "id", ["title", "summary"], k=3, threshold=0.5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.screen_batches(_t(spark, d, "articles"), _t(spark, d, "article_batches")).where("NOT accepted").select("row_id")


def p4_screen(spark: SparkSession, d: str) -> DataFrame:
    """Batch by batch, the rows to accept and the rows to reject."""
    return history.screen_batches(_t(spark, d, "articles"), _t(spark, d, "article_batches"))


def _cut_fields(spark: SparkSession, d: str) -> DataFrame:
    return truncation.without_residue(truncation.cut_values(_t(spark, d, "articles")), _residue(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut_fields(spark, d).where("cut").select("article_id", "field")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts each field."""
    return truncation.rates(_cut_fields(spark, d))


def _capacities(spark: SparkSession, d: str) -> dict[int, int]:
    return {r["container_id"]: r["capacity"] for r in _t(spark, d, "containers").collect()}  # fixed: four kinds


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return cut(packing.token_counts(_t(spark, d, "documents"), packing.tokenizer_file()), "lengths")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_lengths(spark, d), _capacities(spark, d)[CONTAINER]).withColumn("container_id", F.lit(CONTAINER))


def p6_room(spark: SparkSession, d: str) -> DataFrame:
    """The room left over in each kind of container."""
    lengths, out = _lengths(spark, d), None
    for kind, capacity in sorted(_capacities(spark, d).items()):
        part = packing.room(packing.pack(lengths, capacity), capacity).select(F.lit(kind).alias("container_id"), F.lit(capacity).alias("capacity"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")).where("verbatim").select("doc_id", "item_id")


def p7_variants(spark: SparkSession, d: str) -> DataFrame:
    """All leaks, those with other numbers and names included."""
    return leaks.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(_t(spark, d, "documents"), _t(spark, d, "subject_examples")).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """The share of each subject in the corpus."""
    return subjects.composition(subjects.document_subjects(_t(spark, d, "documents"), _t(spark, d, "subject_examples")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_one_form, p3_found, p3_groups, p4_found, p4_screen, p5_found, p5_rates, p6_pack, p6_room, p7_found, p7_variants, p8_found, p8_composition)
}


def _sql_words(text: str) -> str:
    """The words of a text as SQL for DuckDB has them: without markup, in lower case, without punctuation at their ends."""
    space = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    pieces = f"regexp_split_to_array(lower(regexp_replace({text}, '<[A-Za-z/!][^>]*>', ' ', 'g')), '{space}')"
    return f"list_filter(list_transform({pieces}, lambda w: regexp_replace(w, '^[\\p{{P}}\\p{{S}}]+|[\\p{{P}}\\p{{S}}]+$', '', 'g')), lambda w: w <> '')"


def _sql_runs(key: str, table: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i : i + 19], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 18)) AS i FROM (SELECT {key}, {_sql_words('text')} AS w FROM {table} WHERE length(text) > 0))"


#: Texts of documents and items hold no look-alikes or unseen characters that count, so plain words find the same leaks. The
#: other queries need the consistent form, a tokenizer or a model, which SQL has not; tests/llm compares them with brute force.
ORACLES: dict[str, str] = {"p7_found": f"SELECT DISTINCT d.doc_id, i.item_id FROM ({_sql_runs('doc_id', 'documents')}) d JOIN ({_sql_runs('item_id', 'eval_items')}) i ON i.run = d.run"}
