from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import residue as R

SCHEMA = "table_name string, row_key string, text string, source_id string"
NEWS = "The central bank of the valley raised its policy rate by half a point on Friday."


def found(spark, texts):
    rows = [("t", str(i), x, "s") for i, x in enumerate(texts)]
    return {int(r.row_key) for r in R.residue_rows(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_cases_and_no_cases(spark):
    cases = [
        "{{ summary }}", NEWS + " %TITLE%", "@@LEAD@@", "<%= title %>", "TK TK caption TK " + NEWS, "[insert body here]", "«date_line»", "$BODY$ x", "{0}", "__सारांश__ " + NEWS, "%{शीर्षक}", "{विवरण}", "{{lead " + NEWS, "*|CAPTION|*", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod.", "xxxx foo asdf blah qwer test",
        "Text text text text. " + NEWS, "Error 404: Not Found. " + NEWS, "429 Too Many Requests " + NEWS, "<noscript>This site works best with JavaScript enabled.</noscript>", "YOUR BROWSER HAS JAVASCRIPT AND COOKIES SWITCHED OFF, SO PARTS OF THIS PAGE CANNOT BE SHOWN.",
        "Ｅｒｒｏｒ ５０２: Bad Gateway.", "यो पृष्ठ हेर्न ब्राउजरमा जाभास्क्रिप्ट सक्रिय गर्नुहोस्।", "नमुना पाठ नमुना पाठ।",
    ]
    fine = [
        NEWS, "", None, "The portal showed a “404 Not Found” page for 12 hours, she said, and clerks went back to paper forms.", "A poster went to print with the words lorem ipsum on it, and he offered to pay for 20 new copies.", "“The page you are looking for does not exist,” joked the mayor at a rally, mocking the missing report.",
        "She taught 60 pupils to write JavaScript, a language many shops there use.", "Ballots list candidates by set, such as {A, B, C}, a notation that she wants explained.", "Turnout rose 75% to 61% after they went from door to door.", "“They [the engineers] never came,” he said. [Edited for length]", "She said access was denied to 40 reporters at the gate.",
        "फाराममा [नाम] लेख्ने ठाउँ साँघुरो भएको उनले गुनासो गरे।", NEWS * 400,
    ]
    assert found(spark, cases + fine) == set(range(len(cases)))


def test_labels_spread_to_near_duplicates(spark):
    trusted = "Please enable JavaScript to continue"
    like = "Kindly switch on the page programs of your viewer so that the whole of the text of this story can be put on the screen before you"
    seed = "you need to enable javascript and cookies to run this app " + like
    near = "it needs to be put on: javascript and cookies for what follows " + like  # no known phrase makes it residue
    assert found(spark, [trusted, near, NEWS]) == {0}
    got = found(spark, [seed, seed.replace("javascript", "javascript", 1), NEWS])
    assert got == {0, 1}


def test_spreading_reaches_what_only_a_neighbour_is_like(spark):
    rng = np.random.default_rng(1)
    words = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in ("rt", "ns", "lk", "m", "st", "v", "pp", "x", "nd", "sh")]
    base = " ".join(rng.choice(words, 300, replace=False))
    seed = base + " upstream connect error or disconnect/reset before headers"
    second = base + " something else came here"
    third = base.rsplit(" ", 1)[0] + " other something else came here"
    sims = [R.scan(pa.array([x]))["sim"][0] for x in (seed, second, third)]
    close = [bin(int(a) ^ int(b)).count("1") <= R.HAMMING for a, b in zip(sims, sims[1:])]
    want = {0} | ({1} if close[0] else set()) | ({2} if all(close) else set())
    direct = bin(int(sims[0]) ^ int(sims[2])).count("1") <= R.HAMMING
    assert found(spark, [seed, second, third]) == want | ({2} if direct else set())


def test_simhash_is_the_plain_one():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 900, dtype=np.int64).astype(np.uint64)
    seg = np.sort(np.r_[np.zeros(600, np.int64), rng.integers(1, 9, 300)])
    want = []
    for s in range(10):
        own = h[seg == s]
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(0) if len(own) else np.zeros(64)
        want.append(int(np.packbits(bits * 2 > len(own)).view(np.uint64)[0]) if len(own) else 0)
    assert R.simhash(h, seg, 10).tolist() == want


def test_any_two_hashes_three_bits_apart_share_a_table():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, 3, replace=False):
            b ^= 1 << int(bit)
        ka, kb = R.table_keys(np.array([a, b], np.uint64))
        assert (ka == kb).any()


def test_empty_table_repeats_and_keys(spark):
    assert R.residue_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([("t", "1", "{{x}}", "s"), ("t", "1", "{{x}}", "s"), ("u", "1", "{{x}}", "s"), ("u", None, "%BODY%", None)], SCHEMA)
    assert sorted((r.table_name, r.row_key or "") for r in R.residue_rows(df).collect()) == [("t", "1"), ("u", ""), ("u", "1")]


@pytest.mark.parametrize("n", [1, 2])
def test_feed_texts(spark, n):
    raw = spark.createDataFrame([(5, "{{x}}", "extra")], "raw_id long, description string, text string")
    art = spark.createDataFrame([("a", NEWS, "extra")], "id string, summary string, row_key string")
    t = R.feed_texts(raw, art if n == 2 else None)
    assert t.count() == n and {(r.table_name, r.row_key) for r in R.residue_rows(t).collect()} == {("raw_stories", "5")}


def test_spreading_misses_no_pair_of_the_similarity(spark):
    rng = np.random.default_rng(3)
    words = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in ("rt", "ns", "lk", "m", "st", "v", "pp", "x", "nd", "sh")]
    texts = []
    for n in (4, 8, 12, 20, 40) * 4:  # the last word of a phrase is another, so that no phrase is left
        seed = " ".join(rng.choice(words, n, replace=False)) + " the page you are looking for does not exist"
        texts += [seed, seed.rsplit(" ", 1)[0] + " answer"]
    assert found(spark, [*texts, NEWS]) == set(range(len(texts)))
    assert found(spark, [*texts[1::2], NEWS]) == set()


def test_prefix_keys_meet_wherever_sets_are_alike():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        more = int(rng.integers(0, n // 4 + 1))
        common, a, b = (rng.integers(0, 2**63, k, dtype=np.int64) for k in (n, more, n // 4 - more))
        row, key = R.prefix_keys(pa.array([np.sort(np.r_[common, a]), np.sort(np.r_[common, b])], pa.list_(pa.int64())))
        assert set(key[row == 0]) & set(key[row == 1])


def test_labels_spread_from_fields(spark):
    field = "[insert a short description of this article here]"
    assert found(spark, [field, field.strip("[]"), "{{photo}}", "Photo.", NEWS]) == {0, 1, 2}
    assert found(spark, [field.strip("[]"), NEWS]) == set()
