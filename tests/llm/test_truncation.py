from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import truncation as T

SCHEMA = "id string, source_id string, title string, summary string, summary_translated string, cut boolean"


def headline(rnd):
    verb = rnd.choice(["opens", "closes", "names", "moves"])
    return f"{rnd.choice(['Council', 'Bank', 'School', 'Hospital'])} {verb} {rnd.choice(['new', 'old', 'big'])} {rnd.choice(['bridge', 'market', 'road'])} as {'Lu' * rnd.randrange(1, 14)}mo{rnd.randrange(999)} {rnd.choice(['seeks talks', 'urges calm', 'offers help'])}"


def summary(rnd, n):
    return " ".join(f"The office in Town{rnd.randrange(999)} said on Friday that it would {rnd.choice(['open', 'close', 'move'])} {rnd.randrange(99)} more halls before winter." for _ in range(n))


def build(spark):
    rnd = random.Random(0)
    rows, want = [], set()
    for i in range(900):
        src = ["a", "b", "c"][i % 3]
        t, s, tr = headline(rnd), summary(rnd, rnd.randrange(2, 6)), None
        if src == "a" and len(s) > 200 and i % 2 == 0:
            s = s[:200].rstrip()
            if not s.endswith("."):
                want.add((f"i{i}", "summary"))
        if src == "b" and i % 3 == 1 and len(t) > 40 and i % 4 == 0:
            t = t[:40].rstrip()
            want.add((f"i{i}", "title"))
        if src == "c":
            tail = [" [Edited for length]", " (With agency inputs)", " — Lorma Wire", " Photo: desk archive", "", "", " …", " [Continue reading]", "&am"][i % 9]
            if tail in (" …", " [Continue reading]", "&am"):
                s = s[:150] + tail
                want.add((f"i{i}", "summary"))
            else:
                s += tail
        rows.append((f"i{i}", src, t, s, tr, None))
    return spark.createDataFrame(rows, SCHEMA), want


def test_cut_values_and_rates(spark):
    df, want = build(spark)
    out = T.cut_values(df)
    got = {(r.article_id, r.field) for r in out.where("cut").collect()}
    assert {x for x in want if x[1] == "summary"} == {x for x in got if x[1] == "summary"}
    titles, found = {x for x in want if x[1] == "title"}, {x for x in got if x[1] == "title"}
    assert len(titles & found) >= 0.95 * len(titles) and len(found - titles) <= 3
    r = {(x.source_id, x.field): x for x in T.rates(out).collect()}
    assert r["a", "summary"].n == 300 and r["a", "summary"].n_cut == sum(1 for x in want if x[1] == "summary" and int(x[0][1:]) % 3 == 0)
    found = {(x.source_id, x.field, x.unit): x["size"] for x in T.limits(T.field_values(df)).collect()}
    assert found["a", "summary", "chars"] in (199, 200) and found["b", "title", "chars"] in (39, 40)


def test_a_source_that_does_without_full_stops(spark):
    """Its texts are cut at its limit, or where they break off inside a tag; texts of another source that end so are cut anywhere."""
    rnd = random.Random(5)
    said = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 10))) for _ in range(n))
    rows = [(f"x{i}", "bare", None, said(rnd.randrange(9, 40)), None, None) for i in range(200)]
    rows += [(f"y{i}", "bare", None, said(40)[:150], None, None) for i in range(60)]
    rows += [("z", "bare", None, said(12) + " <a hre", None, None)]
    rows += [(f"p{i}", "plain", None, said(rnd.randrange(9, 40)) + ("" if i < 5 else "."), None, None) for i in range(100)]
    out = T.cut_values(spark.createDataFrame(rows, SCHEMA))
    got = {r.article_id: r for r in out.where("cut").collect()}
    assert set(got) - {r[0] for r in rows if r[3] and len(r[3]) == 150} == {"z"} | {f"p{i}" for i in range(5)}
    assert {f"y{i}" for i in range(60)} <= set(got)
    assert got["y1"].at_limit and not got["y1"].by_end and got["p1"].by_end
    r = {x.source_id: x for x in T.rates(out).collect()}
    assert r["plain"].n_end == 5 and r["plain"].n_limit == 0 and r["bare"].n_limit >= 60 and r["bare"].n_end == 1


def test_limits_in_bytes(spark):
    rows = [("s", "summary", 100 + i % 60, 300, True) for i in range(40)] + [("s", "summary", 50 + i, 100 + 7 * i, True) for i in range(30)]
    df = spark.createDataFrame(rows, "source_id string, field string, chars int, bytes int, open boolean")
    assert {(r.unit, r["size"]) for r in T.limits(df).collect()} >= {("bytes", 300)}


def test_nulls_empties_and_long_texts(spark):
    rows = [("a", None, None, None, None, None), ("b", "s", "", "", "  ", None), ("c", "s", "One title", "Whole text. " * 20_000, "Ends in mid sen", None), ("c", "s", "One title", "Whole text. " * 20_000, "Ends in mid sen", None), ("d", "s", "Same words", "Same words", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.article_id, r.field) for r in T.cut_values(df).where("cut").collect() if r.field != "title"}
    assert got == {("c", "summary_translated")}
    assert T.cut_values(df.limit(0)).count() == 0


def test_residue_is_left_out(spark):
    cut = spark.createDataFrame([("a", "summary"), ("a", "title"), ("b", "summary")], "article_id string, field string")
    residue = spark.createDataFrame([("articles", "a"), ("raw_stories", "b")], "table_name string, row_key string")
    assert {(r.article_id, r.field) for r in T.without_residue(cut, residue).collect()} == {("a", "title"), ("b", "summary")}


def test_last_words_are_compared_in_one_form(spark):
    rows = [
        ("soft", "s", "Rain falls near Nalp\u00adadhunubma", "The hills of Nalpadhunubma are wet.", None, None), ("wide", "s", "Rain falls near \uff34ithamsa", "The hills of Tithamsa are wet.", None, None), ("alike", "s", "Rain falls near Tithamsa", "The hills of Tith\u0430msa are wet.", None, None),
        ("tag", "s", "Rain falls near Tithamsa", "The hills of Titha<b>msa</b> <a title=\"of Tithamsa now\">are</a> wet.", None, None), ("inner", "s", "Rain falls near Lo\u2019mar", "The hills of Lo\u2019mar are wet.", None, None), ("dash", "s", "Rain falls near Lo\u2014mar", "The hills of Lo\u2014mar are wet.", None, None),
        ("dot", "s", "Rain falls in the u.s.", "The hills of the U.S. are wet.", None, None), ("begun", "s", "Rain falls near Tith", "The hills of \uff34ithamsa are wet.", None, None), ("joined", "s", "वर्षा \u0930\u094d\u200dया", "त्यो \u0930\u094d\u200dया हो।", None, None), ("none", "s", "Rain falls near Tithamsa", None, None, None),
    ]
    titles = spark.createDataFrame(rows, SCHEMA).selectExpr("id", "source_id", "title", "title AS t", "summary")
    got = {r.id: (r.whole, r.begins) for r in T._last_words(titles, np.empty(0, np.uint64)).collect()}
    whole = {"soft", "wide", "alike", "inner", "dash", "dot", "joined"}
    assert got == {i: (i in whole, i == "begun") for i in got} and len(got) == len(rows)


def test_ends_behind_long_tags_padding_and_notes(spark):
    link = '<img src="https://host.example/' + "x" * 600 + '">'
    whole = ["The council met on Friday. " + link, "The council met on Friday." + "\u00a0 " * 400, "The council met on Friday. (With agency input.)", "The council met on Friday. [Edited for length.]", "He spoke (and then left.) They met."]
    cut = ["The council appr (With agency input.)", "The council appr [Edited for length.]", "The council appr " + link, "The council appr" + "\u200b " * 400]
    rows = [(i, x) for i, x in enumerate(whole + cut)]
    got = {r.i for r in spark.createDataFrame(rows, "i int, x string").where(T._running(F.col("x"))).collect()}
    assert got == set(range(len(whole), len(rows)))
