"""The queries by name, and the SQL that gives the same rows.

Columns are scalars; times are seconds. ``AS_OF`` is the moment that stands for now.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audit, classify, html, tokens
from ..functions import text as tx
from ..functions import url as ul
from ..operators import archive, dedup, enrich, feed, gate, ledger, rank, subscribers
from ..schemas import BUCKETS, LANGS, TOPICS, violations
from ..session import spread
from ..ship import ship
from ..sources import sinks
from ..lineage import new_path
from ..sources.feeds import first_records, read_feeds, read_pages, table, with_pages
from ..streaming import streams
from . import oracles

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = 1_780_142_400  # 2026-05-30 12:00:00 UTC
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def secs(c: str | Column) -> Column:
    return F.unix_seconds((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def now() -> Column:
    return F.lit(AS_OF).cast("long")


def long(c: Column) -> Column:
    return c.cast("long")


def articles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "articles").withColumn("at_s", secs("published_at"))


def scored(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d).where("at_s IS NOT NULL")
    return a.withColumn("score", F.round(rank.score(F.coalesce("coverage_count", F.lit(1)), F.coalesce("credibility", F.lit(5)), F.col("at_s"), F.col("topic"), now()), 6))



def by_score() -> tuple[Column, Column]:
    return F.col("score").desc(), F.col("id").asc()


# ------------------------------------------------------------------ ranking and selections


@query
def rank_stories(s, d):
    """All stories by newsworthiness."""
    return rank.ranked(scored(s, d).select("id", "source_id", "topic", "at_s", "score"), *by_score())


@query
def trending_top6(s, d):
    return rank.trending(scored(s, d).select("id", "source_id", "score"), 6, *by_score())


@query
def ticker_top8(s, d):
    return rank.ticker(articles(s, d).where(F.col("at_s") <= AS_OF).select("id", "topic", "coverage_count", "at_s"), F.col("at_s"), now())


@query
def digest_pick(s, d):
    a = articles(s, d).where(F.col("at_s").between(AS_OF - 86_400, AS_OF + 3_600))
    return rank.digest(a.select("id", "bucket", long(F.col("coverage_count")).alias("coverage_count"), "at_s"), F.col("at_s"), 25).select("id", "section", "coverage_count", "at_s")


@query
def digest_section_counts(s, d):
    a = articles(s, d).where(F.col("at_s").between(AS_OF - 86_400, AS_OF + 3_600))
    return rank.digest(a.select("id", "bucket", "coverage_count", "at_s"), F.col("at_s"), 25).groupBy("section").agg(F.count("*").alias("n"))


@query
def related_stories(s, d):
    a = articles(s, d).select("id", "topic", "at_s")
    own = a.where("topic = 'health'").orderBy(F.col("at_s").desc_nulls_last(), "id").first()  # it would come first, were it not left out
    return rank.related(a, own["id"], "health", F.col("at_s")).select("id", "topic")


@query
def per_source_limit(s, d):
    return first_records(table(s, d, "raw_stories").select("raw_id", "source_id"), "source_id", F.col("raw_id"))


@query
def diversify_by_source(s, d):
    return rank.diversify(scored(s, d), 60, *by_score()).select(long(F.col("pos")).alias("pos"), "id", "source_id")


@query
def feed_page(s, d):
    a = articles(s, d).where("bucket = 'national' AND at_s IS NOT NULL").select("id", "at_s")
    return rank.page(a, 3, 12, a.count(), F.col("at_s").desc(), F.col("id"))


@query
def longest_summary_by_source(s, d):
    return archive.longest_by(table(s, d, "articles"), "source_id", "summary").select("source_id", "id", long(F.col("length")).alias("length"))


# ------------------------------------------------------------------ feed filters and counts


@query
def feed_range_bucket(s, d):
    return feed.in_bucket(feed.in_range(articles(s, d), F.col("at_s"), now(), "month"), "international").select("id", "at_s", "bucket")


@query
def feed_search(s, d):
    return feed.search(table(s, d, "articles"), " Hospital ").select("id", "source_id")


@query
def topic_counts(s, d):
    return feed.topic_counts(feed.in_range(articles(s, d), F.col("at_s"), now(), "month"))


@query
def available_topics(s, d):
    return feed.available_topics(table(s, d, "articles"), TOPICS).select("topic", "n", long(F.col("place")).alias("place"))


@query
def client_items(s, d):
    return feed.client_items(articles(s, d).where("at_s IS NOT NULL"), 1500, F.col("at_s").desc(), F.col("id")).select("id", "title", "source_name", "at_s")


@query
def source_status(s, d):
    raw, src = table(s, d, "raw_stories"), table(s, d, "sources")
    return feed.source_status(raw, src, feed.valid_stories(raw, src))


@query
def ok_sources(s, d):
    raw, src = table(s, d, "raw_stories"), table(s, d, "sources")
    return feed.source_status(raw, src, feed.valid_stories(raw, src)).agg(F.count_if("ok").alias("ok"), F.count("*").alias("n"))


@query
def sources_by_priority(s, d):
    return feed.by_priority(feed.active(table(s, d, "sources"))).select("id", long(F.col("priority")).alias("priority"), "place")


@query
def topic_filter(s, d):
    a = table(s, d, "articles")
    n = lambda t: feed.of_topic(a, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("topic"), "n")
    return n("all").unionByName(n("sports")).unionByName(n("weather"))


@query
def with_summary(s, d):
    return feed.with_summary(table(s, d, "articles")).select("id", "bucket")


@query
def topic_labels(s, d):
    a = table(s, d, "articles")
    return a.select("id", tx.topic_label(F.col("topic"), F.lit("en")).alias("en"), tx.topic_label(F.col("topic"), F.lit("np")).alias("np"), tx.lang_attr(F.col("original_lang")).alias("attr"), tx.lang_name(F.col("original_lang")).alias("lang"))


@query
def reader_languages(s, d):
    return table(s, d, "subscribers").groupBy(tx.subscriber_lang(F.col("language")).alias("lang")).agg(F.count("*").alias("n"))


@query
def source_dim_join(s, d):
    src = feed.source_dim(feed.active(table(s, d, "sources")).select(F.col("id").alias("source_id"), "country", "priority"))
    return table(s, d, "articles").join(src, "source_id").groupBy("country", "priority").agg(F.count("*").alias("n")).select("country", long(F.col("priority")).alias("priority"), "n")


@query
def valid_stories(s, d):
    return feed.valid_stories(table(s, d, "raw_stories"), table(s, d, "sources")).select("raw_id", "source_id")


@query
def normalized_times(s, d):
    """Dates of feed records, read or made up for, never in the future."""
    raw = table(s, d, "raw_stories")
    at = F.coalesce(ul.parse_date(F.col("pub_date")), ul.date_in_url(F.col("url")), secs("fetched_at"))
    return raw.select("raw_id", long(F.least(at, secs("fetched_at"))).alias("at_s"))


@query
def normalize_stories(s, d):
    """Feed records as stories, with all their columns."""
    n = feed.normalize(spread(table(s, d, "raw_stories")), table(s, d, "sources"))
    return n.select("raw_id", "id", "bucket", "title", "summary", "topic", "image_url", long(F.col("published_s")).alias("at_s"), long(F.col("credibility")).alias("credibility"))


@query
def union_feeds(s, d):
    """Fetched and archived stories in one list of addresses."""
    a = table(s, d, "raw_stories").select("source_id", F.col("url").alias("u"))
    return a.unionByName(table(s, d, "articles").select("source_id", F.col("source_url").alias("u"))).groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("u").alias("urls"))


# ------------------------------------------------------------------ duplicates


@query
def dedup_exact(s, d):
    raw = table(s, d, "raw_stories").withColumn("id", ul.fingerprint(F.col("url")))
    return dedup.first_of_each(raw.select("id", "raw_id", "source_id"), "id", F.col("raw_id"))


@query
def title_pairs_jaccard(s, d):
    p = dedup.title_pairs(articles(s, d), "id", F.col("title"), F.col("at_s"))
    return p.select("a", "b", F.round("similarity", 6).alias("similarity"))


def _owners(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = spread(table(s, d, "articles")).withColumn("at_s", secs("published_at")).where("at_s IS NOT NULL").select("id", "title", "at_s", "source_id", "image_url")
    return a, dedup.greedy_alike(a, "id", F.col("title"), F.col("at_s"), -F.col("at_s"))


@query
def dedup_greedy(s, d):
    return _owners(s, d)[1].where("id = owner").select("id")


@query
def coverage(s, d):
    """Kept stories that stand for others too, with their coverage, the other outlets and a picture."""
    a, owners = _owners(s, d)
    c = dedup.coverage(a.withColumn("ord", F.struct((-F.col("at_s")).alias("t"), "id")), owners)
    return c.select("id", long(F.col("coverage_count")).alias("coverage_count"), F.array_join("alternate_source_ids", ",").alias("alternates"), "image_url").where("coverage_count > 1")


# ------------------------------------------------------------------ text


@query
def excerpts(s, d):
    return spread(table(s, d, "documents")).select("doc_id", tx.excerpt(F.col("text"), 400).alias("excerpt"), tx.is_longer(F.col("text"), 400).alias("longer"))


@query
def hard_truncate(s, d):
    return spread(table(s, d, "documents")).select("doc_id", tx.hard_truncate(F.col("text"), 1100).alias("cut"))


@query
def truncate_card(s, d):
    return table(s, d, "articles").select("id", tx.truncate(F.col("summary"), 155).alias("card"))


@query
def word_counts(s, d):
    return spread(table(s, d, "documents")).select("doc_id", long(tx.count_words(F.col("text"))).alias("words"), long(tx.reading_minutes(F.col("text"))).alias("minutes"))


@query
def paragraph_split(s, d):
    p = tx.paragraphs(F.col("text"))
    return spread(table(s, d, "documents")).select("doc_id", F.posexplode(p).alias("pos", "paragraph")).select("doc_id", long(F.col("pos")).alias("pos"), "paragraph")


@query
def html_to_text(s, d):
    return spread(table(s, d, "raw_stories")).select("raw_id", html.to_text(F.coalesce("description", F.lit(""))).alias("text"))


@query
def standfirsts(s, d):
    body = html.to_text(F.coalesce("description", F.lit("")))
    return spread(table(s, d, "raw_stories")).select("raw_id", tx.standfirst(F.col("title"), body).alias("standfirst"))


@query
def strip_boilerplate(s, d):
    t = spread(table(s, d, "articles")).select("id", tx.strip_boilerplate(F.col("summary")).alias("text"), tx.is_boilerplate(F.col("summary")).alias("pitch"))
    return t.where("text IS NOT NULL")


@query
def title_echo(s, d):
    return spread(table(s, d, "raw_stories")).select("raw_id", tx.echoes_title(F.col("title"), html.to_text(F.coalesce("description", F.lit("")))).alias("echo"))


@query
def navigation_text(s, d):
    return spread(table(s, d, "documents")).select("doc_id", tx.is_navigation(F.col("text")).alias("navigation"))


@query
def shown_text(s, d):
    a = table(s, d, "articles").alias("a")
    return a.select("id", tx.shown_text("a", F.lit("en")).alias("x")).select("id", "x.title", "x.summary")


@query
def source_monograms(s, d):
    return table(s, d, "sources").select("id", tx.monogram(F.col("name")).alias("monogram"))


@query
def relative_times(s, d):
    return articles(s, d).where("at_s IS NOT NULL").select("id", tx.relative_time(F.col("at_s"), F.col("original_lang"), now()).alias("said"))


@query
def published_labels(s, d):
    a = articles(s, d).where("at_s IS NOT NULL")
    return a.select("id", ul.published_label(F.col("published_at")).alias("label"), ul.local_day(F.col("published_at")).cast("string").alias("day"))


@query
def escaped_titles(s, d):
    return table(s, d, "articles").select("id", tx.escape_markup(F.col("title")).alias("html"), tx.escape_markup(F.col("title"), "&apos;").alias("xml"))


@query
def summary_bounds(s, d):
    return table(s, d, "articles").where("summary IS NOT NULL").select("id", tx.is_verbatim(F.col("summary"), F.col("original_lang")).alias("verbatim"))


# ------------------------------------------------------------------ audit and classes


@query
def audit_findings(s, d):
    a = spread(table(s, d, "articles"))
    f = a.select("id", F.explode(audit.findings(F.col("summary"), F.col("original_lang"), F.col("title"))).alias("f"))
    return f.select("id", "f.code", "f.severity")


@query
def audit_summary(s, d):
    a = spread(table(s, d, "articles")).withColumn("ok", audit.is_ok(audit.findings(F.col("summary"), F.col("original_lang"), F.col("title"))))
    return a.groupBy("source_id").agg(F.count_if("ok").alias("ok"), F.count("*").alias("n"))


@query
def audit_stories(s, d):
    fs = audit.story_findings(F.col("title"), F.col("summary"), F.col("original_lang"))
    return spread(table(s, d, "articles")).select("id", audit.is_ok(fs).alias("ok"), long(F.size(fs)).alias("n"))


@query
def script_ratio(s, d):
    dv, la, n = tx.script_counts(F.col("text"))
    return spread(table(s, d, "documents")).select("doc_id", F.round(dv / n, 6).alias("devanagari"), F.round(la / n, 6).alias("latin")).where("devanagari IS NOT NULL")


@query
def in_language(s, d):
    return spread(table(s, d, "documents")).where("lang IS NOT NULL").select("doc_id", tx.in_language(F.col("text"), F.col("lang")).alias("ok"))


@query
def classify_topic(s, d):
    a = spread(table(s, d, "articles")).join(feed.source_dim(table(s, d, "sources").select(F.col("id").alias("source_id"), "categories")), "source_id", "left")
    return classify.with_topic(a, "found", F.col("title"), F.col("summary"), F.col("categories")).select("id", "found")


@query
def breaking_flag(s, d):
    return table(s, d, "articles").select("id", classify.is_breaking(F.col("title")).alias("breaking"))


@query
def email_check(s, d):
    return table(s, d, "subscribers").select("id", classify.email_problem(F.col("email")).alias("problem"), F.lower(F.trim("email")).alias("address"))


@query
def mask_email(s, d):
    return table(s, d, "subscribers").where("email IS NOT NULL").select("id", classify.mask_email(F.col("email")).alias("masked"))


@query
def translation_fidelity(s, d):
    a = spread(table(s, d, "articles")).where("summary_translated IS NOT NULL AND summary IS NOT NULL")
    other = F.when(F.col("original_lang") == "en", "np").otherwise("en")
    f = enrich.fidelity(a, F.col("summary"), F.col("summary_translated"), other)
    return f.groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.avg("numbers_kept"), 6).alias("numbers_kept"), F.round(F.avg("script_share"), 6).alias("script_share"), F.round(F.avg("length_ratio"), 6).alias("length_ratio"))


# ------------------------------------------------------------------ addresses


@query
def normalize_url(s, d):
    return table(s, d, "raw_stories").select("raw_id", ul.normalize_url(F.col("url")).alias("u"))


@query
def fingerprint_url(s, d):
    return table(s, d, "raw_stories").select("raw_id", ul.fingerprint(F.col("url")).alias("fingerprint"))


@query
def parsed_dates(s, d):
    return table(s, d, "raw_stories").select("raw_id", long(ul.parse_date(F.col("pub_date"))).alias("at_s"))


@query
def url_dates(s, d):
    return table(s, d, "raw_stories").select("raw_id", long(ul.date_in_url(F.col("url"))).alias("at_s"))


@query
def clean_images(s, d):
    return table(s, d, "raw_stories").select("raw_id", ul.clean_image(F.col("image_url")).alias("image_url"))


@query
def image_host_allowed(s, d):
    hosts = F.array(F.lit("**.kelor-wire.example"), F.lit("img.sulek-times.example"))
    return table(s, d, "raw_stories").where("image_url IS NOT NULL").select("raw_id", ul.host_allowed(F.col("image_url"), hosts).alias("ok"))


@query
def content_keys(s, d):
    return table(s, d, "articles").where("title IS NOT NULL").select("id", ul.content_key(F.col("id"), F.col("title")).alias("key"))


# ------------------------------------------------------------------ gate


@query
def publish_gate(s, d):
    return table(s, d, "articles").select("id", *[gate.publishable(p).alias(f"p_{p}") for p in gate.POLICIES])


@query
def gate_reasons(s, d):
    return gate.withheld(table(s, d, "articles"), "verified")


@query
def preview_policies(s, d):
    return gate.preview(table(s, d, "articles"))


@query
def publish_share(s, d):
    return gate.share_warnings(table(s, d, "articles"))


# ------------------------------------------------------------------ archive and enrichment


def _batch(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "article_batches")
    return b.withColumnRenamed("arrived_at", "last_seen_at").withColumn("alternate_source_ids", F.lit(None).cast("array<string>")).drop("batch_no")


@query
def archive_upsert(s, d):
    last = dedup.first_of_each(_batch(s, d).where("id IS NOT NULL"), "id", F.col("last_seen_at").desc(), F.col("row_id").desc())
    a = archive.upsert(table(s, d, "articles"), last.drop("row_id"))
    return a.select("id", "title", "title_translated", "enrichment_key", long(F.col("coverage_count")).alias("coverage_count"), secs("first_seen_at").alias("first_s"), secs("last_seen_at").alias("last_s"))


@query
def split_for_write(s, d):
    enriched, core = archive.split_for_write(table(s, d, "articles"))
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return n(enriched, "enriched").unionByName(n(core, "core"))


@query
def read_stories(s, d):
    r = archive.read_stories(table(s, d, "articles"))
    return r.select("id", "bucket", "original_lang", "topic", long(F.col("credibility")).alias("credibility"), long(F.col("coverage_count")).alias("coverage_count"), secs("published_at").alias("at_s"), F.array_join("alternate_source_ids", ",").alias("alternates"))


@query
def hydrate_hits(s, d):
    a = table(s, d, "articles")
    pending = table(s, d, "article_batches").where("id IS NOT NULL").select("row_id", "id").join(a.select("id", "enrichment_key"), "id")
    pending = pending.withColumn("enrichment_key", F.when(F.col("row_id") % 3 == 0, F.concat("enrichment_key", F.lit("x"))).otherwise(F.col("enrichment_key")))  # some stories have changed since
    hits, rest = archive.hydrate(pending, a)
    return hits.select("row_id", F.lit("hit").alias("kind")).unionByName(rest.select("row_id", F.lit("pending").alias("kind")))


@query
def live_or_archive(s, d):
    live = table(s, d, "article_batches").where("id IS NOT NULL").select("id", "source_id").distinct()
    live = dedup.first_of_each(live, "id", F.col("source_id"))
    out = archive.live_or_archive(live, table(s, d, "articles").select("id", "source_id"), ["id", "source_id"])
    return out.groupBy("origin", "source_id").agg(F.count("*").alias("n"))


@query
def by_ids(s, d):
    return archive.by_ids(table(s, d, "articles"), table(s, d, "article_batches").select("id")).select("id", "source_id")


@query
def archive_shares(s, d):
    return archive.shares(table(s, d, "articles"))


@query
def sample_for_trial(s, d):
    """The texts that a trial of translators takes: of one language and middling length, last seen first."""
    a = table(s, d, "articles").where((F.col("original_lang") == "np") & (F.length("summary") > 400) & (F.length("summary") < 1600))
    return a.orderBy(F.col("last_seen_at").desc(), F.col("id")).limit(50).select("id")


@query
def enrich_route(s, d):
    a = table(s, d, "articles").withColumn("enrichment_key", F.coalesce("enrichment_key", F.concat(F.col("id"), F.lit(":new"))))
    cached = table(s, d, "articles").where("quality IS NOT NULL").select("enrichment_key")
    return enrich.route(a, cached).groupBy("route").agg(F.count("*").alias("n"))


@query
def batch_assign(s, d):
    a = articles(s, d).where("at_s IS NOT NULL AND enrichment_key IS NULL")
    return enrich.batches(a.select("id", "at_s"), 3, F.col("at_s").desc(), F.col("id")).select("id", long(F.col("batch_no")).alias("batch_no"), long(F.col("place")).alias("place"))


@query
def batch_cap(s, d):
    a = articles(s, d).where("at_s IS NOT NULL AND enrichment_key IS NULL")
    b = enrich.batches(a.select("id", "at_s"), 3, F.col("at_s").desc(), F.col("id"))
    return enrich.affordable(b, 40, 200_000, 8_500).groupBy("batch_no").agg(F.count("*").alias("n")).select(long(F.col("batch_no")).alias("batch_no"), "n")


@query
def reply_pairing(s, d):
    """Replies by id, or by place where an id is missing or wrong."""
    b = enrich.batches(table(s, d, "articles").where("original_lang = 'np'").select("id"), 3, F.col("id")).select("batch_no", "place", "id")
    asked = b.where(F.col("place") >= 0)
    wrong = F.when(F.col("place") == 1, F.lit(None).cast("string")).when((F.col("place") == 2) & (F.col("batch_no") % 2 == 0), F.lit("unknown")).otherwise(F.col("id"))
    replies = b.where(~((F.col("place") == 0) & (F.col("batch_no") % 5 == 0))).select("batch_no", "place", wrong.alias("id"), F.concat(F.lit("reply to "), F.col("id")).alias("reply"))
    return enrich.pair_replies(asked, replies).select(long(F.col("batch_no")).alias("batch_no"), "id", "reply")


@query
def enrich_stub(s, d):
    """A stand-in for a model over the archive, and what its audit lets through."""
    a = spread(table(s, d, "articles")).where("original_lang = 'en'")
    out = enrich.apply(a, enrich.ask(a))
    return out.groupBy("source_id").agg(F.count_if("quality.bilingual").alias("translated"), F.count("*").alias("n"))


@query
def merge_verdicts(s, d):
    a = table(s, d, "articles").where("quality IS NOT NULL")
    v = a.where(F.col("coverage_count") > 1).select("id", (F.length("title") % 2 == 0).alias("summary_ok"), F.when(F.length("title") % 3 == 0, False).alias("translation_ok"))
    m = enrich.merge_verdicts(a, v)
    return m.select("id", F.col("quality.verified").alias("verified"), F.col("quality.bilingual").alias("bilingual"), (F.coalesce("title_translated", F.lit("")) != "").alias("translated"))


@query
def verify_candidates(s, d):
    return enrich.verify_candidates(table(s, d, "articles")).select("id")


@query
def carry_verdicts(s, d):
    """Stories whose audit was made again, with the verdicts that the archive has."""
    a = table(s, d, "articles")
    again = F.when(F.col("quality.audited"), F.struct(F.lit(True).alias("audited"), F.col("quality.bilingual").alias("bilingual"), F.lit(None).cast("boolean").alias("verified"), F.lit(None).cast("string").alias("note")))
    return enrich.carry_verdicts(a.withColumn("quality", again), a).select("id", F.col("quality.audited").alias("audited"), F.col("quality.verified").alias("verified"), F.col("quality.note").alias("note"))


@query
def default_verdicts(s, d):
    return enrich.default_verdicts(table(s, d, "articles")).select("id", F.col("quality.audited").alias("audited"), F.col("quality.bilingual").alias("bilingual"), F.col("quality.verified").alias("verified"))


@query
def names_kept(s, d):
    k = enrich.names_kept(F.col("summary"), F.col("summary_translated"), F.col("original_lang"))
    return spread(table(s, d, "articles")).where("summary IS NOT NULL AND summary_translated IS NOT NULL").select("id", F.round(k, 6).alias("kept"))


@query
def write_counters(s, d):
    """What was counted while the archive was written."""
    rows, seen = archive.counted(table(s, d, "articles"), "archive", translated=F.coalesce("summary_translated", F.lit("")) != "", pictured=F.col("image_url").isNotNull())
    rows.write.parquet(new_path(s, "written"))
    got = seen.get
    return s.createDataFrame([(got["rows"], got["translated"], got["pictured"])], "rows long, translated long, pictured long")


@query
def cap_summaries(s, d):
    return enrich.cap_summaries(spread(table(s, d, "articles"))).select("id", "summary")


@query
def pages_joined(s, d):
    """Feed records with the archive's texts standing for their pages."""
    pages = dedup.first_of_each(table(s, d, "articles").select(F.col("source_url").alias("url"), F.col("summary").alias("text"), "image_url", "id"), "url", F.col("id")).drop("id")
    stories = table(s, d, "raw_stories").select("raw_id", F.col("url").alias("source_url"), F.col("description").alias("summary"), "image_url")
    return with_pages(stories, pages).select("raw_id", long(F.length("summary")).alias("length"), "image_url")


@query
def archive_violations(s, d):
    a = table(s, d, "articles")
    return violations(a, "id", ["title", "published_at", "topic"], {"topic": TOPICS, "bucket": BUCKETS, "original_lang": LANGS}, [("source_id", table(s, d, "sources"), "id")])


# ------------------------------------------------------------------ subscriptions


@query
def subscriber_lookup(s, d):
    asked = table(s, d, "subscribers").where("id % 7 = 0").select(F.upper("email").alias("email"))
    return subscribers.by_email(table(s, d, "subscribers"), asked).select("id", "status")


@query
def subscriber_state(s, d):
    return subscribers.latest_event(table(s, d, "subscription_events")).select("subscriber_id", "event", "n")


@query
def event_details(s, d):
    return subscribers.event_details(table(s, d, "subscription_events"), "lang", "via").groupBy("event", "detail_lang", "detail_via").agg(F.count("*").alias("n"))


@query
def claim_recipients(s, d):
    day = F.to_date(F.lit("2026-05-20"))
    c = subscribers.claimable(table(s, d, "subscribers"), table(s, d, "digest_deliveries"), day, F.lit("2026-05-20 01:00:00").cast("timestamp"))
    return c.select("id", "language")


@query
def delivery_counts(s, d):
    return subscribers.delivery_counts(table(s, d, "digest_deliveries")).select(F.col("digest_date").cast("string").alias("day"), "status", "n")


@query
def mark_delivery(s, d):
    dl = table(s, d, "digest_deliveries")
    marks = dl.where("status = 'sending'").select("digest_date", "subscriber_id", F.lit("failed").alias("status"), "attempted_at", F.lit("claim expired").alias("error"))
    return subscribers.delivery_counts(subscribers.mark(dl, marks)).groupBy("status").agg(F.sum("n").alias("n"))


def _requests(s: SparkSession, d: str) -> DataFrame:
    """Sign-ups: known readers in other letter case, some twice, and new ones."""
    sub = table(s, d, "subscribers").where("email IS NOT NULL AND requested_at IS NOT NULL").withColumn("requested_at", F.col("requested_at").cast("timestamp"))
    again = sub.where("id % 5 = 0").select("id", F.upper("email").alias("email"), F.lit("np").alias("language"), "requested_at", "source_ip", "user_agent")
    twice = sub.where("id % 10 = 0").select("id", F.concat(F.lit(" "), "email").alias("email"), F.lit("xx").alias("language"), (F.col("requested_at") + F.expr("INTERVAL 1 HOUR")).alias("requested_at"), "source_ip", "user_agent")
    new = sub.where("id % 5 = 1").select((F.col("id") + 1_000_000_000).alias("id"), F.concat(F.lit("New."), "email").alias("email"), "language", "requested_at", "source_ip", "user_agent")
    return again.unionByName(twice).unionByName(new)


def _readers(s: SparkSession, d: str) -> DataFrame:
    """The subscribers with one row for each address, as a store that is keyed by it has them."""
    sub = table(s, d, "subscribers")
    sub = sub.select(*[F.col(f.name).cast("timestamp") if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in sub.schema])
    return dedup.first_of_each(sub.where("email IS NOT NULL").withColumn("e", F.lower(F.trim("email"))), "e", F.col("id")).drop("e")


@query
def subscriber_upsert(s, d):
    return subscribers.request(_readers(s, d), _requests(s, d)).select("id", F.lower(F.trim("email")).alias("email"), "language", "status", secs("requested_at").alias("at_s"))


def _confirmed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _readers(s, d)
    known = r.where("id % 3 = 0").select("id", F.upper("email").alias("email"), F.timestamp_seconds(F.lit(AS_OF)).alias("at"))
    new = r.where("id % 7 = 0").select((F.col("id") + 1_000_000_000).alias("id"), F.concat(F.lit("late."), "email").alias("email"), F.timestamp_seconds(F.lit(AS_OF)).alias("at"))
    return subscribers.confirm(r, known.unionByName(new))


@query
def confirm_subscribers(s, d):
    rows, _ = _confirmed(s, d)
    return rows.select("id", F.lower(F.trim("email")).alias("email"), "status", secs("confirmed_at").alias("confirmed_s"), secs("unsubscribed_at").alias("left_s"))


@query
def unsubscribe_readers(s, d):
    r = _readers(s, d)
    rows, _ = subscribers.unsubscribe(r, r.where("id % 4 = 0").select("email", F.timestamp_seconds(F.lit(AS_OF)).alias("at")))
    return rows.select("id", "status", secs("unsubscribed_at").alias("left_s"))


@query
def event_log(s, d):
    """The log with the changes that confirmations make, numbered on."""
    events = table(s, d, "subscription_events").withColumn("at", F.col("at").cast("timestamp"))
    return subscribers.log(events, _confirmed(s, d)[1]).select("id", "subscriber_id", "event", secs("at").alias("at_s"), "detail")


def _claim(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dl = table(s, d, "digest_deliveries").withColumn("attempted_at", F.col("attempted_at").cast("timestamp"))
    had = table(s, d, "subscribers").where("id % 11 = 0").select("id")
    return subscribers.claim(table(s, d, "subscribers"), dl, F.to_date(F.lit("2026-05-20")), F.lit("2026-05-20 01:00:00").cast("timestamp"), 25, had)


@query
def claim_lease(s, d):
    """The first recipients that a run may still claim, without those that it has had."""
    return _claim(s, d)[1]


@query
def claim_ledger(s, d):
    """The deliveries after that claim."""
    return _claim(s, d)[0].select(F.col("digest_date").cast("string").alias("day"), "subscriber_id", "status", secs("attempted_at").alias("at_s"), "error")


@query
def delivered_to(s, d):
    x = subscribers.delivered_to(table(s, d, "digest_deliveries"), table(s, d, "subscribers"))
    return x.groupBy("status", "language").agg(F.count("*").alias("n"), F.count_distinct("email").alias("readers"))


# ------------------------------------------------------------------ ledgers


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("at_s", secs("ts"))


@query
def sliding_rate(s, d):
    r = ledger.sliding_rate(events(s, d).select("event_id", "user_id", "at_s"), "user_id", F.col("at_s"), 3_600, 2)
    return r.select("event_id", "in_window", long(F.col("wait_s")).alias("wait_s"))


@query
def fixed_window_limit(s, d):
    r = ledger.fixed_windows(events(s, d), "user_id", "event_id", F.col("at_s"), 21_600, 2)
    return r.select("user_id", "event_id", long(F.col("n")).alias("n"), "allowed", "retry_s")


@query
def daily_ledger(s, d):
    r = ledger.daily(events(s, d), F.col("ts"), F.col("value"), 20_000.0, "event_type")
    return r.select(F.col("day").cast("string").alias("day"), "event_type", "n", F.round("spent", 4).alias("spent"), F.round("left", 4).alias("left"))


@query
def running_spend(s, d):
    r = ledger.running_spend(events(s, d), F.col("ts"), "event_id", F.col("value"))
    return r.select("event_id", F.round("spent_so_far", 4).alias("spent_so_far"))


@query
def ewma_cost(s, d):
    r = ledger.smoothed_cost(events(s, d).withColumn("day", F.to_date("ts").cast("string")), "day", F.col("event_id"), F.round(F.col("value") * 100))
    return r.select("day", "cost", long(F.col("n")).alias("n"))


@query
def local_day_counts(s, d):
    return events(s, d).groupBy(ul.local_day(F.col("ts")).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query
def refusal_cooldowns(s, d):
    """Waiting times read out of refusals that are made of the events."""
    e = events(s, d).withColumn("k", F.pmod("event_id", F.lit(4)))
    body = F.when(F.col("k") == 0, F.concat(F.lit("Limit reached. Used "), F.col("event_id").cast("string"), F.lit(". Please try again in "), F.pmod("event_id", F.lit(7)).cast("string"), F.lit("m20s"))).when(F.col("k") == 1, "requests per day exceeded").otherwise("busy")
    header = F.when(F.col("k") == 2, F.pmod("event_id", F.lit(90)).cast("string"))
    return e.select("event_id", ledger.cooldown_s(header, body).cast("double").alias("wait_s"), ledger.reported_usage(body).alias("used"))


@query
def never_lower(s, d):
    """What counts as spent in a day, where refusals name amounts that may be greater."""
    e = events(s, d).withColumn("body", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("Rate limit. Used "), F.col("event_id").cast("string"))))
    day = e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("own"), F.max_by("body", F.coalesce(ledger.reported_usage(F.col("body")), F.lit(-1))).alias("body"))
    return day.select("day", ledger.never_lower(F.col("own"), F.col("body")).alias("spent"))


# ------------------------------------------------------------------ streams


@query
def stream_tumbling_counts(s, d):
    w = streams.windowed_counts(streams.read_stream(s, d, "events"), "ts", "1 day", "event_type", value="value")
    return streams.run_to_end(w, "tumbling", "complete").select(secs("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def stream_sliding_counts(s, d):
    w = streams.windowed_counts(streams.read_stream(s, d, "events"), "ts", "12 hours", slide="6 hours")
    return streams.run_to_end(w, "sliding", "complete").select(secs("start").alias("start_s"), "n")


@query
def stream_dedup_ids(s, d):
    e = streams.read_stream(s, d, "events")
    both = e.select("event_id", "ts").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return streams.run_to_end(streams.without_repeats(both, "event_id", "ts"), "repeats").select("event_id")


@query
def stream_without_alike(s, d):
    """Stories as they arrive, without those that tell what a kept one within two hours has told."""
    a = streams.read_stream(s, d, "articles").where("published_at IS NOT NULL").select("id", "title", "published_at")
    return streams.without_alike(a, "id", "title", "published_at").select("id")


@query
def stream_upsert(s, d):
    """Batches of articles merged into the archive as they arrive."""
    stream = streams.read_stream(s, d, "article_batches")
    last = lambda df: dedup.first_of_each(df.where("id IS NOT NULL").withColumnRenamed("arrived_at", "last_seen_at"), "id", F.col("last_seen_at").desc(), F.col("row_id").desc()).drop("row_id", "batch_no")
    a = streams.upsert_stream(stream, table(s, d, "articles").drop("quality", "alternate_source_ids"), "id", last)
    return a.select("id", "title", "title_translated", secs("first_seen_at").alias("first_s"), secs("last_seen_at").alias("last_s"))


@query
def stream_first_hits(s, d):
    """How many events of each user a limit lets through, with state kept by user."""
    r = streams.run_to_end(streams.first_hit_limit(streams.read_stream(s, d, "events"), "user_id", "ts", 21_600, 2), "hits")
    return r.groupBy("user_id").agg(F.sum("allowed").alias("allowed"), F.sum("denied").alias("denied"))


# ------------------------------------------------------------------ files, pages, tokens


def _as_file(batches):
    """The items of a file between the head and the foot of a feed."""
    line = lambda x: pa.record_batch([pa.array([x])], names=["value"])
    yield line('<?xml version="1.0"?><rss version="2.0"><channel>')
    yield from batches
    yield line("</channel></rss>")


@query
def xml_feed_parse(s, d):
    """Feed records written as RSS items and read again."""
    x = lambda c: tx.escape_markup(F.coalesce(c, F.lit("")))
    raw = spread(table(s, d, "raw_stories"))
    item = F.concat(F.lit("<item><title>"), x(F.col("title")), F.lit("</title><link>"), x(F.col("url")), F.lit("</link><description>"), x(F.col("description")), F.lit("</description><guid>"), F.col("raw_id").cast("string"), F.lit("</guid></item>"))
    path = new_path(s, "feeds")
    ship(s)
    raw.select(item.alias("value")).mapInArrow(_as_file, "value string").write.text(path)
    return read_feeds(s, path).select(F.col("guid").cast("long").alias("raw_id"), "title", "url", "description")


def _pages(s: SparkSession, d: str) -> DataFrame:
    a = spread(table(s, d, "articles")).where("summary IS NOT NULL AND summary <> ''")
    x = lambda c: tx.escape_markup(F.coalesce(c, F.lit("")))
    ld = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.concat("summary", F.lit(" "), "summary").alias("articleBody"))), F.lit("</script>"))
    head = F.concat(F.lit('<html><head><meta property="og:title" content="'), x(F.col("title")), F.lit('"><meta content="'), x(F.substring("summary", 1, 140)), F.lit('" name="description"><meta property="og:image" content="'), x(F.col("image_url")), F.lit('">'), F.when(F.col("coverage_count") > 1, ld).otherwise(""), F.lit("</head>"))
    body = F.concat(F.lit("<body><script>if (1 < 2) {}</script><p>Share</p><p class='t'>"), x(F.col("summary")), F.lit("</p><p>All rights reserved.</p></body></html>"))
    return a.select("id", F.col("source_url").alias("url"), F.lit("text/html; charset=utf-8").alias("content_type"), F.concat(head, body).alias("html"), "summary", "coverage_count", "image_url")


@query
def parse_pages(s, d):
    """Pages made of the archive, read: which account of the article each gives."""
    p = _pages(s, d)
    return read_pages(p).groupBy("via").agg(F.count("*").alias("n"), F.count("image_url").alias("images"))


@query
def page_meta(s, d):
    p = _pages(s, d).withColumn("m", html.meta_tags(F.col("html")))
    return p.select("id", long(F.size("m")).alias("tags"), html.meta_content(F.col("m"), "property:og:title").alias("title"))


@query
def page_paragraphs(s, d):
    return _pages(s, d).select("id", html.paragraph_text(F.col("html")).alias("text"))


@query
def signed_tokens(s, d):
    sub = table(s, d, "subscribers").where("email IS NOT NULL AND requested_at IS NOT NULL").withColumn("t", secs("requested_at"))
    return sub.select("id", tokens.create(F.col("email"), "confirm", F.col("t"), b"secret").alias("token"))


@query
def token_checks(s, d):
    sub = table(s, d, "subscribers").where("email IS NOT NULL AND requested_at IS NOT NULL").withColumn("t", secs("requested_at"))
    token = tokens.create(F.col("email"), "confirm", F.col("t"), b"secret")
    sub = sub.withColumn("token", F.when(F.col("id") % 4 == 0, F.concat(token, F.lit("x"))).when(F.col("id") % 4 == 1, "none").otherwise(token))
    v = tokens.verify(F.col("token"), "confirm", F.col("t") + F.when(F.col("id") % 4 == 2, 3 * 86_400).otherwise(0), b"secret")
    return sub.select("id", v.alias("v")).select("id", "v.ok", "v.email", "v.reason")


@query
def recent_stories(s, d):
    """A range of time by a parameterised statement."""
    articles(s, d).createOrReplaceTempView("newsloom_articles")
    return s.sql("SELECT id, at_s FROM newsloom_articles WHERE at_s BETWEEN :since AND :until ORDER BY at_s DESC, id LIMIT 300", args={"since": AS_OF - 72 * 3_600, "until": AS_OF + 3_600})


# ------------------------------------------------------------------ sinks


@query
def news_sitemap(s, d):
    return sinks.news_sitemap(articles(s, d).where(F.col("at_s") <= AS_OF), F.col("at_s"), now(), "https://news.example", "News")


@query
def sitemap(s, d):
    return sinks.sitemap(articles(s, d).where("at_s IS NOT NULL"), F.col("at_s"), "https://news.example")


@query
def structured_data(s, d):
    """A schema.org object for each story, read again."""
    j = sinks.structured_data(articles(s, d), F.col("at_s"))
    return j.select("id", F.get_json_object("json", "$.headline").alias("headline"), F.get_json_object("json", "$.publisher").alias("publisher"))


@query
def digest_lines(s, d):
    a = articles(s, d).where(F.col("at_s").between(AS_OF - 86_400, AS_OF + 3_600))
    return sinks.digest_lines(rank.digest(a, F.col("at_s"), 25), "https://news.example")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in QUERIES}
