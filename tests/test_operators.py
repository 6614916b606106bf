"""Operators on small tables, against plain loops where order matters."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import archive, dedup, enrich, feed, gate, ledger, order, rank, subscribers
from newsloom.schemas import ARTICLE, violations
from newsloom.sources import feeds

STORY = "id string, source_id string, topic string, coverage_count int, credibility int, at long, bucket string"
NOW = 1_700_000_000


def stories(spark, rows):
    return spark.createDataFrame([(i, s, t, c, k, NOW - age, "national") for i, s, t, c, k, age in rows], STORY)


def by_score():
    s = rank.score(F.col("coverage_count"), F.col("credibility"), F.col("at"), F.col("topic"), F.lit(NOW))
    return s.desc(), F.col("id")


def test_rank(spark):
    df = stories(spark, [("minor", "a", "x", 1, 5, 0), ("biggest", "b", "x", 4, 8, 0), ("middling", "c", "x", 2, 6, 0)])
    assert [r.id for r in df.orderBy(*by_score()).collect()] == ["biggest", "middling", "minor"]
    assert df.where("id = 'minor'").select(rank.score(F.lit(1), F.lit(7), F.lit(NOW), F.lit("x"), F.lit(NOW))).first()[0] == pytest.approx(106.0)


def test_trending_fills_up(spark):
    df = stories(spark, [("a", "s1", "x", 9, 5, 0), ("b", "s1", "x", 8, 5, 0), ("c", "s1", "x", 7, 5, 0), ("d", "s2", "x", 1, 5, 0)])
    assert [r.id for r in rank.trending(df, 4, *by_score()).collect()] == ["a", "b", "d", "c"]
    assert [r.id for r in rank.trending(df, 3, *by_score()).collect()] == ["a", "b", "d"]


def test_ticker(spark):
    df = stories(spark, [("old", "a", "breaking", 1, 5, 13 * 3600), ("fresh", "b", "breaking", 1, 5, 60), ("newest", "c", "x", 1, 5, 1)])
    assert [r.id for r in rank.ticker(df, F.col("at"), F.lit(NOW)).collect()] == ["fresh", "newest"]


def test_digest_cuts_before_it_divides(spark):
    df = spark.createDataFrame([("n1", 2, 1, "national"), ("w1", 5, 1, "international"), ("n2", 1, 1, "national"), ("w2", 4, 1, "international")], "id string, coverage_count int, at long, bucket string")
    assert {(r.id, r.section) for r in rank.digest(df, F.col("at"), 3).collect()} == {("w1", "international"), ("w2", "international"), ("n1", "national")}
    assert rank.digest(df, F.col("at"), 0).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_diversify_is_the_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"i{i:02}", f"s{rnd.randrange(3)}", "x", 50 - i, 5, 0) for i in range(20)]
    look = rnd.choice([2, 3, 14])
    pool, want = list(rows), []
    while pool:
        k = 0
        if want and pool[0][1] == want[-1][1]:
            k = next((j for j in range(1, min(look, len(pool))) if pool[j][1] != want[-1][1]), 0)
        want.append(pool.pop(k))
    got = rank.diversify(stories(spark, rows), 20, *by_score(), lookahead=look).orderBy("pos").collect()
    assert [r.id for r in got] == [w[0] for w in want]
    assert rank.diversify(stories(spark, rows).limit(0), 20, *by_score()).count() == 0


def test_page_numbers():
    assert rank.page_numbers(1, 3) == [1, 2, 3]
    assert rank.page_numbers(6, 12) == [1, None, 5, 6, 7, None, 12]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_dedup_is_the_loop(spark, seed):
    rnd = random.Random(seed)
    words = ["flood", "hits", "valley", "rescue", "teams", "bridge", "falls", "north"]
    rows = [(f"r{i:03}", " ".join(rnd.sample(words, 5)), NOW - rnd.randrange(20_000), f"s{rnd.randrange(4)}", None if rnd.random() < 0.5 else f"p{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, title string, at long, source_id string, image_url string")
    pairs = dedup.title_pairs(df, "id", F.col("title"), F.col("at"))
    want_pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[2] - b[2]) <= 7200 and len(set(a[1].split()) & set(b[1].split())) / len(set(a[1].split()) | set(b[1].split())) >= 0.45}
    assert {(r.a, r.b) for r in pairs.collect()} == want_pairs
    kept, owner = [], {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        hit = next((k for k in kept if tuple(sorted((k[0], r[0]))) in want_pairs), None)
        owner[r[0]] = hit[0] if hit else r[0]
        if not hit:
            kept.append(r)
    owners = dedup.greedy(df, "id", pairs.select("a", "b"), -F.col("at"))
    assert {r.id: r.owner for r in owners.collect()} == owner
    place = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    ord_ = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    cov = {r.id: r for r in dedup.coverage(df.withColumn("ord", F.element_at(ord_, F.col("id"))), owners).collect()}
    for k in kept:
        mine = sorted((r for r in rows if owner[r[0]] == k[0]), key=lambda r: place[r[0]])
        outlets = list(dict.fromkeys(r[3] for r in mine))
        assert cov[k[0]].coverage_count == len(outlets)
        assert (cov[k[0]].alternate_source_ids or []) == [s for s in outlets if s != k[3]]
        assert cov[k[0]].image_url == (k[4] or next((r[4] for r in mine if r[4]), None))


def test_dedup_of_nothing(spark):
    df = spark.createDataFrame([], "id string, title string, at long")
    pairs = dedup.title_pairs(df, "id", F.col("title"), F.col("at"))
    assert pairs.count() == 0
    lone = spark.createDataFrame([("a", None, None), ("b", "", 5)], "id string, title string, at long")
    none = dedup.title_pairs(lone, "id", F.col("title"), F.col("at")).select("a", "b")
    assert {r.owner for r in dedup.greedy(lone, "id", none, F.col("at")).collect()} == {"a", "b"}


def article(spark, **values):
    names = [f.split()[0] for f in ARTICLE.split("quality")[0].rstrip(", ").split(", ")] + ["quality"]
    return spark.createDataFrame([tuple(values.get(n) for n in names)], ARTICLE)


def test_upsert_keeps_what_a_batch_lacks(spark):
    old = article(spark, id="a", title="Old", title_translated="T", enrichment_key="k", coverage_count=1)
    batch = spark.createDataFrame([("a", "New", None), ("b", "Other", 3)], "id string, title string, coverage_count int")
    got = {r.id: r for r in archive.upsert(old, batch).collect()}
    assert (got["a"].title, got["a"].title_translated, got["a"].enrichment_key, got["a"].coverage_count) == ("New", "T", "k", None)
    assert got["b"].title == "Other" and got["b"].title_translated is None


def test_record_writes_both_kinds(spark):
    old = article(spark, id="a", title="Old", title_translated="T", enrichment_key="k")
    items = article(spark, id="a", title="Core only", enrichment_key="").unionByName(article(spark, id="c", title="Rich", title_translated="R", enrichment_key="z"))
    got = {r.id: r for r in archive.record(old, items).collect()}
    assert got["a"].title == "Core only" and got["a"].title_translated == "T" and got["c"].title_translated == "R"


def test_read_stories_fills_in(spark):
    r = archive.read_stories(article(spark, id="a", bucket="odd", original_lang="xx", topic="odd", alternate_source_ids=[])).first()
    assert (r.bucket, r.original_lang, r.topic, r.credibility, r.coverage_count, r.alternate_source_ids) == ("national", "np", "society", 5, 1, None)


def test_gate_policies_shrink(spark):
    rows = [("a", "text", None), ("b", "text", (True, False, None, None)), ("c", "text", (True, True, None, None)), ("d", "text", (True, True, True, None)), ("e", "text", (True, True, False, None)), ("f", "", (True, True, True, None))]
    df = spark.createDataFrame(rows, "id string, summary string, quality struct<audited: boolean, bilingual: boolean, verified: boolean, note: string>")
    assert {r.policy: r.n for r in gate.preview(df).collect()} == {"all": 6, "audited": 4, "bilingual": 3, "verified": 1}
    assert {r.reason: r.n for r in gate.withheld(df, "verified").collect()} == {"not audited": 1, "not bilingual": 1, "not yet verified": 1, "failed verification": 1, "no body text": 1}
    assert df.where(gate.publishable("nonsense")).count() == 4


def test_replies_by_id_then_by_place(spark):
    asked = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "c")], "batch_no int, place int, id string")
    replies = spark.createDataFrame([(0, 0, "c", "first"), (0, 1, None, "second"), (0, 2, "c", "again")], "batch_no int, place int, id string, reply string")
    assert {r.id: r.reply for r in enrich.pair_replies(asked, replies).collect()} == {"a": None, "b": "second", "c": "first"}


def test_bad_translation_is_withdrawn(spark):
    a = article(spark, id="a", title_translated="T", summary_translated="S", quality=(True, True, None, None))
    v = spark.createDataFrame([("a", None, False)], "id string, summary_ok boolean, translation_ok boolean")
    r = enrich.merge_verdicts(a, v).first()
    assert r.title_translated is None and r.quality.verified is False and r.quality.bilingual is False
    r = enrich.merge_verdicts(a, v.limit(0)).first()
    assert r.title_translated == "T" and r.quality.verified is None


@pytest.mark.parametrize("seed", range(3))
def test_fixed_windows_are_the_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"k{rnd.randrange(3)}", i, rnd.randrange(2000)) for i in range(80)]
    want, state = {}, {}
    for k, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        start, n = state.get(k, (None, 0))
        start, n = (at, 1) if start is None or at - start >= 100 else (start, n + 1)
        state[k] = (start, n)
        want[i] = (n, n <= 3, 0 if n <= 3 else max(1, start + 100 - at))
    df = spark.createDataFrame(rows, "k string, i int, at long")
    got = ledger.fixed_windows(df, "k", "i", F.col("at"), 100, 3)
    assert {r.i: (r.n, r.allowed, r.retry_s) for r in got.collect()} == want


def test_smoothed_cost(spark):
    df = spark.createDataFrame([("d", 1, 10_000.0), ("d", 2, 0.0), ("d", 3, 5_000.0)], "day string, i int, x double")
    assert ledger.smoothed_cost(df, "day", F.col("i"), F.col("x")).first()["cost"] == 7765  # 8500 -> 8950 -> 7765


def test_claims_skip_fresh_leases(spark):
    subs = spark.createDataFrame([(1, "confirmed"), (2, "confirmed"), (3, "confirmed"), (4, "pending")], "id long, status string")
    d = spark.sql("SELECT date'2026-01-01' AS digest_date, * FROM VALUES (1L, 'sent', timestamp'2026-01-01 00:00:00'), (2L, 'sending', timestamp'2026-01-01 00:50:00'), (3L, 'sending', timestamp'2026-01-01 00:30:00') AS t(subscriber_id, status, attempted_at)")
    got = subscribers.claimable(subs, d, F.to_date(F.lit("2026-01-01")), F.lit("2026-01-01 01:00:00").cast("timestamp"))
    assert [r.id for r in got.collect()] == [3]


def test_violations(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "odd")], "id string, kind string")
    ref = spark.createDataFrame([("x",)], "name string")
    got = {(r.rule, r.key): r.n for r in violations(df, "id", ["kind"], {"kind": ["x", "y"]}, [("kind", ref, "name")]).collect()}
    assert got == {("not_null:kind", "a"): 1, ("one_of:kind", "b"): 1, ("unique", "a"): 2, ("refers:kind", "b"): 1}


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>C</title>
<item><title><![CDATA[First &amp; best]]></title><link>https://a.example/1</link><description>Short</description><content:encoded><![CDATA[<p>A longer text</p>]]></content:encoded><pubDate>Wed, 29 Apr 2026 20:15:19 GMT</pubDate><media:content url="https://a.example/1.jpg"/><guid>g1</guid></item>
<item><title>No link</title><guid>https://a.example/2</guid><description>x &lt;img src="https://a.example/2.jpg"/&gt;</description></item><item><title>ab</title><link>https://a.example/3</link></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Entry one</title><id>tag:1</id><link rel="self" href="https://b.example/self"/><link rel="alternate" href="https://b.example/1"/><updated>2026-05-05T05:03:39Z</updated><summary>Said</summary></entry></feed>"""
RDF = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><item rdf:about="https://c.example/1"><title>Resource</title><dc:date>2026-05-05T05:03:39Z</dc:date></item></rdf:RDF>"""


def test_feeds(spark, tmp_path):
    for name, body in (("a.xml", RSS), ("b.xml", ATOM), ("c.xml", RDF)):
        (tmp_path / name).write_text(body)
    got = {r.url: r for r in feeds.read_feeds(spark, str(tmp_path)).collect()}
    assert set(got) == {"https://a.example/1", "https://a.example/2", "https://b.example/1", "https://c.example/1"}
    assert (got["https://a.example/1"].title, got["https://a.example/1"].description, got["https://a.example/1"].image_url, got["https://a.example/1"].guid) == ("First & best", "A longer text", "https://a.example/1.jpg", "g1")
    assert got["https://a.example/2"].image_url == "https://a.example/2.jpg"
    assert got["https://b.example/1"].pub_date == "2026-05-05T05:03:39Z" and got["https://c.example/1"].pub_date == "2026-05-05T05:03:39Z"


def test_feed_filters(spark):
    df = spark.createDataFrame([("a", "Flood in valley", None, "Outlet", "national"), ("b", None, "big FLOOD", "Outlet", "international")], "id string, title string, summary string, source_name string, bucket string")
    assert feed.search(df, " flood ").count() == 2 and feed.search(df, "").count() == 2 and feed.search(df, "outlet").count() == 2
    assert feed.in_bucket(df, "national").count() == 1 and feed.in_bucket(df, "odd").count() == 2
    with pytest.raises(ValueError, match="range"):
        feed.in_range(df.withColumn("at", F.lit(0)), F.col("at"), F.lit(0), "year")


@pytest.mark.parametrize("seed", range(2))
def test_greedy_by_classes_is_greedy_by_pairs(spark, seed):
    rnd = random.Random(seed)
    words = [f"word{i}" for i in range(9)]
    rows = [(f"i{i:03}", " ".join(rnd.sample(words, rnd.randrange(2, 5))), rnd.randrange(30_000)) for i in range(150)]
    rows += [(f"e{i:03}", "one headline for them all", 1000 * i) for i in range(60)] + [("n1", None, 5), ("n2", "one headline for them all", None)]
    df = spark.createDataFrame(rows, "id string, title string, at long")
    pairs = dedup.cut(dedup.title_pairs(df, "id", F.col("title"), F.col("at")), "pairs")
    both = {}
    for i, t, at in rows:
        both[i] = (set((t or "").split()), at)
    want = {(a, b) for a in both for b in both if a < b and None not in (both[a][1], both[b][1]) and abs(both[a][1] - both[b][1]) <= 7200 and both[a][0] and both[b][0] and len(both[a][0] & both[b][0]) >= 0.45 * len(both[a][0] | both[b][0])}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    one = {r.id: r.owner for r in dedup.greedy(df, "id", pairs.select("a", "b"), -F.col("at")).collect()}
    two = {r.id: r.owner for r in dedup.greedy_alike(df, "id", F.col("title"), F.col("at"), -F.col("at")).collect()}
    assert one == two and len(one) == len(rows)


def test_places_and_running_sums_by_ranges(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(3), rnd.randrange(50), float(rnd.randrange(9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, k long, at long, x double").repartition(7)
    got = {r.i: r.n for r in order.numbered(df, "n", F.col("at").desc(), F.col("i").asc()).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    sums, want = {}, {}
    for i, k, at, x in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = sums[k] = sums.get(k, 0) + x
    assert {r.i: r.s for r in order.running_sum(df, "s", F.col("k"), F.col("x"), F.col("at").asc(), F.col("i").asc()).collect()} == want
    assert order.numbered(df.limit(0), "n", F.col("i").asc()).count() == 0


def test_a_lease_is_taken_once(spark):
    subs = spark.createDataFrame([(i, f"r{i}@a.example", "en", "confirmed" if i != 3 else "pending") for i in range(1, 7)] + [(7, None, None, None)], "id long, email string, language string, status string")
    old = [("2026-05-20", 1, "sent", "2026-05-20 00:10:00", None), ("2026-05-20", 2, "sending", "2026-05-20 00:50:00", None), ("2026-05-20", 4, "sending", "2026-05-20 00:30:00", None), ("2026-05-20", 5, "failed", "2026-05-20 00:59:00", "x"), ("2026-05-19", 6, "sent", "2026-05-19 00:10:00", None)]
    dl = spark.createDataFrame(old, "d string, subscriber_id long, status string, a string, error string").select(F.to_date("d").alias("digest_date"), "subscriber_id", "status", F.to_timestamp("a").alias("attempted_at"), "error")
    day, now = F.to_date(F.lit("2026-05-20")), F.lit("2026-05-20 01:00:00").cast("timestamp")
    after, got = subscribers.claim(subs, dl, day, now, 2, spark.createDataFrame([(4,), (None,)], "id long"))
    assert [r.id for r in got.collect()] == [5, 6]
    assert {(str(r.digest_date), r.subscriber_id): r.status for r in after.collect()} == {("2026-05-20", 1): "sent", ("2026-05-20", 2): "sending", ("2026-05-20", 4): "sending", ("2026-05-20", 5): "sending", ("2026-05-20", 6): "sending", ("2026-05-19", 6): "sent"}
    again, more = subscribers.claim(subs, after, day, now, 9)
    assert [r.id for r in more.collect()] == [4]  # what a run has just claimed, no other may
    assert again.count() == 6


def test_a_repeated_sign_up_makes_no_second_row(spark):
    kind = "id long, email string, language string, status string, requested_at timestamp, confirmed_at timestamp, unsubscribed_at timestamp, source_ip string, user_agent string"
    t = lambda h: datetime.datetime(2026, 1, 1, h)
    subs = spark.createDataFrame([(1, "A@x.example", "en", "confirmed", t(1), t(2), None, "ip", "ua"), (2, None, None, None, None, None, None, None, None)], kind)
    req = spark.createDataFrame([(9, " a@X.example", "np", t(5), "i9", "u9"), (10, "b@x.example", "xx", t(6), "i10", "u" * 900), (11, "B@x.example", "np", t(7), "i11", "u11"), (12, None, "np", t(7), None, None)], "id long, email string, language string, requested_at timestamp, source_ip string, user_agent string")
    rows = {r.id: r for r in subscribers.request(subs, req).collect()}
    assert set(rows) == {1, 2, 10}
    assert (rows[1].status, rows[1].language, rows[1].requested_at, rows[1].source_ip) == ("confirmed", "np", t(5), "ip")
    assert (rows[10].status, rows[10].language, rows[10].requested_at, rows[10].source_ip, len(rows[10].user_agent)) == ("pending", "np", t(7), "i10", 500)
    after, changes = subscribers.confirm(subs, spark.createDataFrame([(20, "a@x.example", t(8)), (21, "c@x.example", t(9))], "id long, email string, at timestamp"))
    assert {r.id: r.status for r in after.collect()} == {1: "confirmed", 2: None, 21: "confirmed"}
    assert [(r.subscriber_id, r.detail) for r in changes.collect()] == [(21, '{"backfilled":true}')]
    left, changes = subscribers.unsubscribe(after, spark.createDataFrame([("A@X.example", t(10)), ("nobody", t(10))], "email string, at timestamp"))
    assert {r.id: r.status for r in left.collect()} == {1: "unsubscribed", 2: None, 21: "confirmed"} and changes.count() == 1


def test_files_that_cannot_be_read_have_a_row(spark, tmp_path):
    (tmp_path / "good.xml").write_text("<rss><channel><item><title>A good title</title><link>https://a.example/1</link></item></channel></rss>")
    (tmp_path / "bad.xml").write_text("<rss><channel><item><title>A bad title</title><link>https")
    (tmp_path / "empty.xml").write_text("")
    at = f"file://{tmp_path}"
    got = {r.file.rsplit("/", 1)[1]: (r.ok, r.n, r.error) for r in feeds.file_status(spark, at, feeds.read_feeds(spark, at)).collect()}
    assert got == {"good.xml": (True, 1, None), "bad.xml": (False, 0, "no record could be read"), "empty.xml": (False, 0, "the file is empty")}


def test_verdicts_are_carried_only_over_a_passed_audit(spark):
    q = "id string, quality struct<audited: boolean, bilingual: boolean, verified: boolean, note: string>"
    new = spark.createDataFrame([("a", (True, True, None, None)), ("b", None), ("c", (True, False, True, "own")), ("d", (True, True, None, None))], q)
    old = spark.createDataFrame([("a", (True, True, False, "why")), ("b", (True, True, True, None)), ("c", (True, True, None, "x"))], q)
    got = {r.id: r.quality and (r.quality.verified, r.quality.note) for r in enrich.carry_verdicts(new, old).collect()}
    assert got == {"a": (False, "why"), "b": None, "c": (True, "own"), "d": (None, None)}
