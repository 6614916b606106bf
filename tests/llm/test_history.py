from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import history as H

BATCH = "batch_no int, row_id long, id string, source_url string, title string, published_at timestamp, ref string"
ART = "id string, source_url string, title string, published_at timestamp, ref string"
T0 = datetime.datetime(2026, 1, 1)
WORDS = [f"w{i}" for i in range(14)]


def make(seed, n=60):
    rnd = random.Random(seed)

    def row(i):
        t = None if rnd.random() < 0.1 else T0 + datetime.timedelta(minutes=rnd.randrange(600))
        title = None if rnd.random() < 0.05 else " ".join(rnd.sample(WORDS, rnd.randrange(3, 7)))
        return (None if rnd.random() < 0.1 else f"id{rnd.randrange(80)}", None if rnd.random() < 0.1 else f"https://a.example/p{rnd.randrange(60)}", title, t)

    arts = [row(i) for i in range(20)]
    batches = [(1 + 3 * i // n, i + 1, *row(i)) for i in range(n)]
    return arts, batches


def brute(arts, batches):
    known = list(arts)
    out = {}
    for b in sorted(batches, key=lambda r: r[1]):
        _, rid, id_, url, title, at = b
        hit = False
        for k in known:
            words, mine = set((k[2] or "").split()), set((title or "").split())
            close = at is not None and k[3] is not None and abs((at - k[3]).total_seconds()) <= 7200
            if (id_ is not None and id_ == k[0]) or (url and url == k[1]) or (close and words and mine and 10 * len(words & mine) >= 7 * len(words | mine)):
                hit = True
                break
        out[rid] = not hit
        if not hit:
            known.append((id_, url, title, at))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_batches_one_after_another(spark, seed):
    arts, batches = make(seed)
    a = spark.createDataFrame([(*r, "x") for r in arts], ART).where("id IS NOT NULL")
    b = spark.createDataFrame([(*r, "x") for r in batches], BATCH)
    want = brute([r for r in arts if r[0] is not None], batches)
    assert {r.row_id: r.accepted for r in H.screen_batches(a, b).collect()} == want
    assert {r.row_id: r.accepted for r in H.screen_batches(a, b, one_task=0).collect()} == want  # in rounds


def test_a_crowd_of_equal_rows_and_of_nulls(spark):
    rows = [(1, i, "same", "https://a.example/x", "one two three four", T0, "") for i in range(1, 301)] + [(1, 400 + i, None, None, None, None, "") for i in range(3)] + [(2, 500, "other", "https://a.example/y", "one two three four", T0 + datetime.timedelta(hours=2), ""), (2, 501, "third", "", "one two three four", T0 + datetime.timedelta(hours=2, seconds=1), "")]
    got = {r.row_id: r.accepted for r in H.screen_batches(spark.createDataFrame([], ART), spark.createDataFrame(rows, BATCH)).collect()}
    assert [k for k, v in got.items() if v and k < 400] == [1]
    assert all(got[400 + i] for i in range(3))
    assert got[500] is False and got[501] is True


def test_rejected_rows_do_not_count(spark):
    h = lambda n: T0 + datetime.timedelta(hours=n)
    rows = [(1, 1, "a", "u1", "a b c d e f g", h(0), ""), (1, 2, "b", "u2", "a b c d e f g x", h(2), ""), (1, 3, "c", "u3", "a b c d e f g x y", h(4), "")]
    got = {r.row_id: r.accepted for r in H.screen_batches(spark.createDataFrame([], ART), spark.createDataFrame(rows, BATCH)).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_no_batches(spark):
    assert H.screen_batches(spark.createDataFrame([], ART), spark.createDataFrame([], BATCH)).count() == 0


def test_bloom_filter_lets_all_known_keys_through_and_few_others(spark):
    arts = spark.createDataFrame([(f"i{i}", f"https://a.example/{i}", f"t{i} u{i} v{i}", T0, "") for i in range(3000)], ART)
    h = H.History.create(arts)
    keys = h.keys().select("key", "cls").distinct()
    assert h.screen_keys(keys).count() == keys.count()
    others = spark.range(20_000).select(F.xxhash64("id").alias("key"), F.lit(None).cast("long").alias("cls"))
    assert h.screen_keys(others).count() < 400


def test_a_history_is_opened_again_without_the_archive(spark, tmp_path):
    arts, batches = make(5)
    arts = [r for r in arts if r[0] is not None]
    path = f"file://{tmp_path}/history"
    H.History.create(spark.createDataFrame([(*r, "x") for r in arts], ART), path)
    got = {}
    for n in (1, 2, 3):
        h = H.History.open(spark, path)
        assert h.version == n
        got |= {r.row_id: r.accepted for r in h.screen(spark.createDataFrame([(*r, "x") for r in batches if r[0] == n], BATCH)).collect()}
        if n == 2:
            H.History.open(spark, path).merge()  # one run of all; a version more
            h = H.History.open(spark, path)
            assert len(h.runs) == 1
            (tmp_path / "history" / "keys" / "run=99").mkdir()  # left by a batch that failed
            break
    h = H.History.open(spark, path)
    got |= {r.row_id: r.accepted for r in h.screen(spark.createDataFrame([(*r, "x") for r in batches if r[0] == 3], BATCH)).collect()}
    assert got == brute(arts, batches)
    with pytest.raises(ValueError, match="no history"):
        H.History.open(spark, f"file://{tmp_path}")


def test_runs_are_merged(spark, monkeypatch):
    monkeypatch.setattr(H, "MERGE", 2)
    monkeypatch.setattr(H, "BUCKET_KEYS", 8)
    arts, batches = make(7)
    arts = [r for r in arts if r[0] is not None]
    got = {r.row_id: r.accepted for r in H.screen_batches(spark.createDataFrame([(*r, "x") for r in arts], ART), spark.createDataFrame([(*r, "x") for r in batches], BATCH)).collect()}
    assert got == brute(arts, batches)


def test_winnowed_words_of_partners_meet():
    rnd = np.random.default_rng(0)
    common = np.sort(rnd.choice(40, 6, replace=False)).astype(np.uint64)
    for _ in range(2000):
        n = rnd.integers(1, 30)
        a = np.unique(rnd.choice(40, n)).astype(np.uint64)
        b = np.unique(np.r_[rnd.choice(a, len(a) - rnd.integers(0, 1 + len(a) // 4), replace=False), rnd.choice(40, rnd.integers(0, 3))]).astype(np.uint64)
        both = len(np.intersect1d(a, b))
        if both * 10 >= 7 * (len(a) + len(b) - both):
            ka, kb = (H.winnow(x, np.zeros(len(x), np.int64), common)[1] for x in (a, b))
            assert len(np.intersect1d(ka, kb))


def test_one_headline_without_end(spark):
    """A headline that a third of all rows have, at other times each: the store holds it once a slot."""
    arts = spark.range(20_000).select(F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("https://a.example/"), "id").alias("source_url"), F.lit("one two three four five").alias("title"), F.timestamp_seconds(F.lit(1_767_225_600) + F.col("id")).alias("published_at"))
    h = H.History.create(arts)
    assert h.keys().where("cls IS NOT NULL").count() <= 4 * 2
    rows = [(1, i, f"n{i}", f"https://b.example/{i}", "one two three four five", T0 + datetime.timedelta(seconds=20_000 + 7200 + i - 3), "") for i in range(6)]
    got = {r.row_id: r.accepted for r in h.screen(spark.createDataFrame(rows, BATCH)).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: False, 5: False}


@pytest.mark.parametrize(
    ("url", "same"),
    [("http://www.A.example/x/", True), ("https://m.a.example/x#top", True), ("https://a.example/x?utm_source=q&fbclid=1&trkCampaign=2", True), ("https://a.example:443/x", True), ("https://a.example/x?lang=np", False), ("https://a.example/x?p=2", False), ("https://b.example/x", False), ("https://a.example/X", False)],
)
def test_pages(spark, url, same):
    df = spark.createDataFrame([(url, "https://a.example/x")], "a string, b string").select(H.page_of(F.col("a")) == H.page_of(F.col("b")))
    assert df.first()[0] is same
