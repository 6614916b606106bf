"""Signed tokens, streams and sinks."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from newsloom.functions import tokens
from newsloom.sources import feeds, sinks
from newsloom.streaming import streams

KEY = b"a secret"


def plain(email, kind, t, key=KEY):
    p = base64.urlsafe_b64encode(json.dumps({"e": email, "k": kind, "t": t}, separators=(",", ":")).encode()).rstrip(b"=")
    return (p + b"." + base64.urlsafe_b64encode(hmac.new(key, p, hashlib.sha256).digest()).rstrip(b"=")).decode()


@pytest.mark.parametrize("key", [KEY, b"k" * 100])
def test_tokens_are_hmac(spark, key):
    df = spark.createDataFrame([("A@b.example", 1_700_000_000)], "e string, t long")
    assert df.select(tokens.create(F.col("e"), "confirm", F.col("t"), key)).first()[0] == plain("a@b.example", "confirm", 1_700_000_000, key)
    with pytest.raises(ValueError, match="kind"):
        tokens.create(F.col("e"), "other", F.col("t"), key)


def test_verification(spark):
    t = 1_700_000_000
    good, other, old, bad = plain("a@b.example", "confirm", t), plain("a@b.example", "unsubscribe", t - 10**7), plain("a@b.example", "confirm", t - 3 * 86_400), plain("a@b.example", "confirm", t, b"wrong")
    df = spark.createDataFrame([(x,) for x in (good, other, old, bad, "no.dots.here", "", None)], "x string")
    got = [tuple(r[0]) for r in df.select(tokens.verify(F.col("x"), "confirm", F.lit(t), KEY)).collect()]
    assert got == [(True, "a@b.example", None), (False, None, "kind"), (False, None, "expired"), (False, None, "signature"), (False, None, "malformed"), (False, None, "malformed"), (False, None, "malformed")]
    assert df.select(tokens.verify(F.col("x"), "unsubscribe", F.lit(t), KEY)["ok"]).collect()[1][0] is True


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(i, i % 3, 1_700_000_000 + 60 * i) for i in range(30)] + [(5, 2, 1_700_000_000 + 300)]
    df = spark.createDataFrame(rows, "id long, user long, s long").select("id", "user", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    return streams.read_stream(spark, str(tmp_path), "t")


def test_windows(stream):
    out = streams.run_to_end(streams.windowed_counts(stream, "ts", "10 minutes"), "w", "complete")
    assert sum(r.n for r in out.collect()) == 31


def test_repeats(stream):
    assert streams.run_to_end(streams.without_repeats(stream, "id", "ts"), "r").count() == 30


def test_first_hits(stream):
    out = streams.run_to_end(streams.first_hit_limit(stream, "user", "ts", 600, 2), "h").collect()
    assert {r.user: (r.allowed, r.denied) for r in out} == {0: (6, 4), 1: (6, 4), 2: (6, 5)}


def test_upserts(spark, tmp_path):
    spark.createDataFrame([("a", "one")], "id string, title string").write.parquet(str(tmp_path / "u.parquet"))
    old = spark.createDataFrame([("a", "zero", "kept"), ("b", "b", "kept")], "id string, title string, extra string")
    got = streams.upsert_stream(streams.read_stream(spark, str(tmp_path), "u"), old, "id")
    assert {(r.id, r.title, r.extra) for r in got.collect()} == {("a", "one", "kept"), ("b", "b", "kept")}


def test_sinks(spark):
    df = spark.createDataFrame([("x", "A & 'B'", "np", 1_700_000_000, "Outlet", "s" * 300, 2, "https://a.example", "national")], "id string, title string, original_lang string, at long, source_name string, summary string, coverage_count int, source_url string, section string")
    entry = sinks.news_sitemap(df, F.col("at"), F.lit(1_700_000_000), "https://n.example", "N").first()["entry"]
    assert "<news:language>ne<" in entry and "A &amp; &apos;B&apos;" in entry and "2023-11-14T22:13:20.000Z" in entry
    doc = json.loads(sinks.structured_data(df, F.col("at")).first()["json"])
    assert doc["@type"] == "NewsArticle" and len(doc["description"]) == 201
    assert "(2 outlets)" in sinks.digest_lines(df, "https://n.example").first()["line"]
    assert json.loads(sinks.as_json(df.select("id", F.lit(None).cast("int").alias("n"))).first()["json"]) == {"id": "x"}


def test_pages_fill_stories(spark):
    stories = spark.createDataFrame([("u1", "short", None), ("u2", "a longer summary", "i"), ("u3", None, None)], "source_url string, summary string, image_url string")
    pages = spark.createDataFrame([("u1", "a text that is longer", "p1"), ("u2", "tiny", "p2"), ("u1", "a text that is longer", "p1")], "url string, text string, image_url string")
    got = {r.source_url: (r.summary, r.image_url) for r in feeds.with_pages(stories, pages).collect()}
    assert got == {"u1": ("a text that is longer", "p1"), "u2": ("a longer summary", "i"), "u3": (None, None)}


def test_a_view_is_refreshed_and_served(spark, tmp_path):
    import time

    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    spark.createDataFrame([(1,), (2,)], "x long").coalesce(1).write.parquet(f"file://{src}")
    q = streams.refreshed(spark.readStream.schema("x long").parquet(f"file://{src}"), lambda df: df.agg(F.sum("x").alias("s")), out, "1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            if (tmp_path / "out").exists() and any((tmp_path / "out").glob("*/_SUCCESS")):
                break
        assert streams.latest(spark, out).first().s == 3
    finally:
        q.stop()


def test_stream_keeps_what_nothing_before_it_has_told(spark, tmp_path):
    """The same as the greedy choice over all rows in order of time, over several batches."""
    from newsloom.operators import dedup

    rows = [(f"i{i:02}", f"story number {i % 7} of the {('day', 'night')[i % 2]}", i * 900) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, title string, at_s long")
    for k in range(4):
        df.where(f"at_s >= {k * 9000} AND at_s < {(k + 1) * 9000}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        import time

        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema("id string, title string, at_s long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in").withColumn("at", F.timestamp_seconds("at_s"))
    got = {r.id for r in streams.without_alike(stream, "id", "title", "at").collect()}
    want = {r.id for r in dedup.greedy_alike(df, "id", F.col("title"), F.col("at_s"), F.col("at_s")).where("id = owner").collect()}
    assert got == want
