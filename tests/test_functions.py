"""Scalar functions on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsloom.functions import audit, classify, html
from newsloom.functions import text as tx
from newsloom.functions import url as ul


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_jaccard_of_headlines(spark):
    a, b = "Earthquake shakes western Nepal villages", "Earthquake shakes western Nepal, officials say"
    ta, tb = tx.title_tokens(F.col("a")), tx.title_tokens(F.col("b"))
    assert one(spark, tx.jaccard(ta, tb), a=a, b=b) == pytest.approx(4 / 7)
    assert one(spark, tx.jaccard(ta, tb), a=a, b="") == 0.0


def test_tokens_drop_short_words_and_split_at_marks(spark):
    assert one(spark, tx.title_tokens(F.col("a")), a="An Act, an act! IMF") == ["act", "imf"]
    assert one(spark, tx.title_tokens(F.col("a")), a="नेपाल") == []
    assert one(spark, tx.title_tokens(F.col("a"), keep_marks=True), a="नेपाल") == ["नेपाल"]


@pytest.mark.parametrize(("text", "most", "want"), [("short", 10, "short"), ("One two. Three four five six.", 16, "One two. Three…"), ("One two three. Four", 16, "One two three."), ("abcdefghijkl", 5, "abcde…"), ("  padded  ", 20, "padded")])
def test_excerpt(spark, text, most, want):
    assert one(spark, tx.excerpt(F.col("a"), most), a=text) == want


def test_hard_truncate_drops_marks_before_the_cut(spark):
    assert one(spark, tx.hard_truncate(F.col("a"), 12), a="alpha beta, gamma") == "alpha beta…"
    assert one(spark, tx.hard_truncate(F.col("a"), 12), a="alpha beta. gamma") == "alpha beta."


def test_paragraphs(spark):
    long_ = " ".join(f"Sentence number {i} is here to fill the page with words." for i in range(8))
    got = one(spark, tx.paragraphs(F.col("a")), a=long_)
    assert len(got) == 3 and " ".join(got) == long_
    assert one(spark, tx.paragraphs(F.col("a")), a="  short. text.  ") == ["short. text."]
    assert one(spark, tx.paragraphs(F.col("a")), a="   ") == []


def test_standfirst_never_repeats_the_headline(spark):
    t = "Bank raises rate"
    body = "Bank raises rate: The central bank said on Friday that it would raise its rate by half a point."
    assert one(spark, tx.standfirst(F.col("t"), F.col("d")), t=t, d=body).startswith("The central bank")
    assert one(spark, tx.standfirst(F.col("t"), F.col("d")), t=t, d="Bank raises rate!") == ""
    assert one(spark, tx.standfirst(F.col("t"), F.col("d")), t=t, d="") == ""


def test_monogram_and_words(spark):
    assert one(spark, tx.monogram(F.col("a")), a="The Lorma Green") == "LG"
    assert one(spark, tx.monogram(F.col("a")), a="Sulek") == "SU"
    assert one(spark, tx.monogram(F.col("a")), a="---") == "?"
    assert one(spark, tx.count_words(F.col("a")), a="one – two 3 ...") == 3
    assert one(spark, tx.reading_minutes(F.col("a")), a="") == 1


@pytest.mark.parametrize(("minutes", "lang", "want"), [(0, "en", "Just now"), (1, "en", "1 min ago"), (90, "en", "1 hour ago"), (1500, "en", "Yesterday"), (4000, "en", "2 days ago"), (30, "np", "30 मिनेट अघि"), (-5, "en", "Just now")])
def test_relative_time(spark, minutes, lang, want):
    assert one(spark, tx.relative_time(F.lit(1_000_000 - minutes * 60), F.lit(lang), F.lit(1_000_000))) == want


def test_markup_never_welds_words(spark):
    text = "a<b>x</b>c<td>one</td><td>two</td>&nbsp;three<!-- no --><style>p {}</style>four<script>if (a < b) {}</script>five<br/>six &lt;seven&gt; Q&rsquo;s &#2344;&#X947;"
    assert one(spark, html.to_text(F.col("a")), a=text) == "a x c one two three four five six <seven> Q's ने"
    import duckdb

    from newsloom.plans.oracles import to_text

    assert duckdb.execute(f"SELECT {to_text('a')} FROM (SELECT ? AS a)", [text]).fetchone()[0] == "a x c one two three four five six <seven> Q's ने"


def test_entities_by_rule(spark):
    cases = {"": "", "&": "&", "&&amp;&": "&&&", "&AMP;&Hellip;&PRIME;": "&…′", "&Prime;": "″", "&T;&A;Q&A;": "&T;&A;Q&A;", "&#0;&#1114112;&#9999999;&#31;": "    ", "&#10;&#9;x": "\n\tx", "&#128512;": "😀", "&amp;#2342;": "द", "&amp;amp;amp;": "&amp;", "पद्&zwj;मा": "पद्\u200dमा", "a&shy;b": "ab", "&#12345678;": "&#12345678;"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "a string").select("a", html.decode_entities(F.col("a")).alias("b"))
    assert {r.a: r.b for r in df.collect()} == cases | {None: None}
    import duckdb

    from newsloom.plans.oracles import decode

    for k, v in cases.items():
        assert duckdb.execute(f"SELECT {decode('a')} FROM (SELECT ? AS a)", [k]).fetchone()[0] == v, k


def test_entities_decode_twice_and_keep_unknown_names(spark):
    assert one(spark, html.decode_entities(F.col("a")), a="AT&T &amp;amp; &#2344;&#x947; &nope; &#55296;x") == "AT&T & ने &nope;  x"


def test_markup_to_text(spark):
    assert one(spark, html.to_text(F.col("a")), a="<style>p{}</style><p>One<br/>two</p><p>three &amp; four</p><!-- no -->") == "One two three & four"


PAGE = """<html><head><meta content='Given &lt;p&gt;text' property="og:description"><meta property='og:description' content='second'>
<meta name="twitter:image" content="/pics/a.jpg"><script type="application/ld+json">{"@graph":[{"articleBody":"%s"},{"description":"short"}]}</script></head>
<body><p>Tiny.</p><p>%s</p></body></html>"""


def parse(spark, page, url):
    df = spark.createDataFrame([(page, url, "kept")], "html string, url string, other string")
    return html.parse_articles(df).first()


def test_article_prefers_structured_data_and_resolves_the_picture(spark):
    body, para = "Structured sentence here. " * 30, "A paragraph of running text that goes on for a while. " * 4
    got = parse(spark, PAGE % (body.strip(), para), "https://site.example/x/y")
    assert got["via"] == "jsonld" and got["text"] == body.strip() and got["image_url"] == "https://site.example/pics/a.jpg" and got["other"] == "kept"
    got = parse(spark, PAGE % ("short one", para), "http://site.example/")
    assert got["via"] == "paragraphs" and got["image_url"] is None and got["text"] == para.strip()
    assert parse(spark, "<p>nothing</p>", "https://site.example/") is None


def test_first_meta_tag_wins(spark):
    assert one(spark, html.meta_content(html.meta_tags(F.col("h")), "property:og:description"), h=PAGE) == "Given text"


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://A.example/x/?utm_source=q&b=2&a=1#top", "a.example/x?b=2&a=1"), ("http://a.example", "a.example/"), ("https://a.example:443/", "a.example/"), ("https://a.example:8080/p/", "a.example:8080/p"), ("not an address", "not an address"), ("https://a.example/?REF=z", "a.example/")],
)
def test_normalize_url(spark, url, want):
    assert one(spark, ul.normalize_url(F.col("a")), a=url) == want


@pytest.mark.parametrize(("text", "want"), [("Wed, 29 Apr 2026 20:15:19 GMT", 1777493719), ("2026-05-21T06:56:18+00:00", 1779346578), ("2026-05-05T05:03:39Z", 1777957419), ("Fri, 27 Feb 2026 10:33:04 +0545", 1772167684), ("yesterday", None), ("-", None), ("0000-00-00", None), (None, None)])
def test_dates(spark, text, want):
    assert one(spark, ul.parse_date(F.col("a")), a=text) == want


def test_date_in_url_runs_over(spark):
    assert one(spark, ul.date_in_url(F.col("a")), a="https://x.example/2026/02/30/story") == 1772452800
    assert one(spark, ul.date_in_url(F.col("a")), a="https://x.example/story") is None


def test_images(spark):
    assert one(spark, ul.clean_image(F.col("a")), a="http://x.example/a.jpg") is None
    assert one(spark, ul.clean_image(F.col("a")), a="https://x.example/img/pixel/1x1.gif") is None
    assert one(spark, ul.clean_image(F.col("a")), a=" https://x.example/pixels.jpg ") == "https://x.example/pixels.jpg"
    hosts = F.array(F.lit("**.x.example"), F.lit("y.example"))
    for url, want in (("https://a.x.example/1", True), ("https://x.example/1", False), ("https://notx.example/", False), ("https://y.example/", True), ("http://y.example/", False)):
        assert one(spark, ul.host_allowed(F.col("a"), hosts), a=url) is want


def test_content_key(spark):
    h = 2166136261
    for ch in "नेपाल ok":
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    digits, n = "", h
    while n:
        n, r = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    assert one(spark, ul.content_key(F.col("i"), F.col("a")), i="x", a="नेपाल ok") == f"x:{digits}"


CLEAN = "The central bank raised its policy rate by half a point on Friday, its first increase this year."


@pytest.mark.parametrize(
    ("text", "lang", "code"),
    [
        ("", "en", "empty"), ("Too short.", "en", "too-short"), (CLEAN + " �", "en", "encoding-artifact"), ("<b>" + CLEAN, "en", "markup-leak"), (CLEAN[:-1] + " &nbsp; x.", "en", "entity-leak"), ("Here is the summary. " + CLEAN, "en", "model-preamble"),
        ("As an AI I cannot do it. " + CLEAN, "en", "model-refusal"), (CLEAN[:-1], "en", "truncated"), (CLEAN[:-1] + " and the.", "en", "truncated"), (CLEAN + " " + CLEAN, "en", "repetition"), (CLEAN, "np", "wrong-script"),
    ],
)
def test_audit_codes(spark, text, lang, code):
    got = one(spark, audit.findings(F.col("a"), F.lit(lang)), a=text)
    assert code in [f["code"] for f in got]


def test_audit_passes_clean_text_and_warns_without_failing(spark):
    assert one(spark, audit.findings(F.col("a"), F.lit("en"), F.lit("Bank raises rate")), a=CLEAN) == []
    assert one(spark, audit.is_ok(audit.findings(F.col("a"), F.lit("en"))), a=CLEAN + " " + CLEAN) is True
    assert one(spark, audit.told(audit.findings(F.col("a"), F.lit("en"))), a=CLEAN) == "clean"
    assert [f["code"] for f in one(spark, audit.findings(F.col("a"), F.lit("en"), F.lit(CLEAN)), a=CLEAN)] == ["headline-echo"]


def test_topics(spark):
    some, none = F.array(F.lit("nothing"), F.lit("Markets")), F.array().cast("array<string>")
    df = spark.createDataFrame([("Cricket team wins", ""), ("A note", "the bank"), ("A note", "a hospital"), (None, None), ("The mental health of a team", "विद्यालय")], "t string, s string")
    topics = lambda cats: [r.x for r in classify.with_topic(df, "x", F.col("t"), F.col("s"), cats).collect()]
    assert topics(some) == ["sports", "business", "business", "business", "health"]
    assert topics(none) == ["sports", "business", "health", "world", "health"]
    assert topics(F.lit(None).cast("array<string>")) == ["sports", "business", "health", "world", "health"]
    assert one(spark, classify.is_breaking(F.col("t")), t="Live update: flood") is True
    assert one(spark, classify.is_breaking(F.col("t")), t="Heartbreaking") is False


@pytest.mark.parametrize(("raw", "problem"), [(None, "empty"), ("  ", "empty"), ("a@b", "shape"), ("A@B.example", None), ("x@yopmail.com", "disposable"), ("a b@c.example", "shape"), ("a" * 250 + "@b.example", "too-long")])
def test_email(spark, raw, problem):
    assert one(spark, classify.email_problem(F.col("a")), a=raw) == problem


@pytest.mark.parametrize(("raw", "masked"), [("reader@example.com", "r•••••@example.com"), ("ab@x.example", "a•@x.example"), ("@x.example", "•••"), ("nothing", "•••")])
def test_mask(spark, raw, masked):
    assert one(spark, classify.mask_email(F.col("a")), a=raw) == masked
