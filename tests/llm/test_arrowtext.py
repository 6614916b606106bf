"""Whole-batch text work against plain Python."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import arrowtext as A


def canon(*texts):
    cp, off, changed = A.canonical(*A.explode(pa.array(texts, pa.string())))
    return A.implode(cp, off).to_pylist(), changed.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8))
def test_round_trip(texts):
    col = pa.array(texts, pa.string())
    cp, off = A.explode(col)
    null = col.is_null().to_numpy(zero_copy_only=False)
    assert A.implode(cp, off, null).to_pylist() == texts


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ｆｕｌｌ　ｗｉｄｔｈ１２", "Full width12"), ("oﬃce ﬁre", "office fire"), ("no break thin", "no break thin"), ("ze​ro﻿ wi­dth‎", "zero width"), ("é ñ ü", "é ñ ü"), ("ố", "ố"),
        ("раypal Сabinet", "paypal Cabinet"), ("νisіts", "visits"), ("अाग्रह", "आग्रह"), ("दिए| अनि", "दिए। अनि"), ("𝐁𝐨𝐥𝐝", "Bold"), ("क़", "क़"),
    ],
)
def test_one_form(text, want):
    assert canon(text) == ([want], [True])


@pytest.mark.parametrize("text", ["", "“curly” – dash… é ñ", "«Дулма» Тавор Ζορκία", "गर्‍यो", "{{शीर्षक|truncate:80}}", "a | b", "tab\tand\nline", "नेपाल ०१२", "x" * 5000])
def test_left_alone(text):
    assert canon(text) == ([text], [False])


def test_nulls_empty_and_order():
    assert canon(None, "", "ａ", "b") == (["", "", "a", "b"], [False, False, True, False])
    assert canon() == ([], [])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é́ñ ｂｃ​р", max_size=20))
def test_twice_is_once(text):
    (once,), _ = canon(text)
    assert canon(once) == ([once], [False])
    assert once == unicodedata.normalize("NFC", once)


def plain_words(text):
    out = []
    for piece in text.split():
        lo, hi = 0, len(piece)
        while lo < hi and unicodedata.category(piece[lo])[0] in "PS":
            lo += 1
        while hi > lo and unicodedata.category(piece[hi - 1])[0] in "PS":
            hi -= 1
        if lo < hi:
            out.append(piece[lo:hi].lower())
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abC, .|“”é-\n ", max_size=25), max_size=6))
def test_words(texts):
    cp, off = A.explode(pa.array(texts, pa.string()))
    w = A.Words(cp, off)
    want = [plain_words(t) for t in texts]
    low = A.implode(w.low, np.array([0, len(w.low)])).to_pylist()[0] if len(w.low) else ""
    got = [[] for _ in texts]
    for r, a, b in zip(w.row, w.start, w.end, strict=True):
        got[r].append(low[a:b])
    assert got == want
    by: dict[str, int] = {}
    for word, h in zip([x for t in want for x in t], w.hash.tolist(), strict=True):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_shingles_stay_in_their_row():
    w = A.Words(*A.explode(pa.array(["a b c d", "a b", "", "b c d"])))
    h, row = w.shingles(3)
    assert row.tolist() == [0, 0, 3] and h[1] == h[2] != h[0]
    assert len(w.shingles(9)[0]) == 0


def test_tags_become_blanks():
    cp, off = A.explode(pa.array(["<p>one</p> 2 < 3 > x", "<b", "a<br/>b<%= t %>"]))
    assert A.implode(A.blank_tags(cp, off), off).to_pylist() == ["   one     2 < 3 > x", "<b", "a     b<%= t %>"]


def test_slices_keep_every_row():
    b = pa.record_batch([pa.array(["x" * (1 << 19)] * 5 + [None, ""])], names=["t"])
    parts = list(A.slices(b, "t"))
    assert sum(p.num_rows for p in parts) == 7 and len(parts) > 1
    assert list(A.slices(b.slice(0, 0), "t")) == []


def test_unseen_characters_of_the_last_planes():
    from newsloom.llm import arrowtext

    cp, off, changed = arrowtext.canonical(*arrowtext.explode(pa.array(["ne\U000e0001ws", "ne\U000e0041ws", "ne\U000e01efws", "news"])))
    assert arrowtext.implode(cp, off).to_pylist() == ["news"] * 4 and changed.tolist() == [True, True, True, False]


def test_plain_texts_are_those_that_stay():
    rnd = np.random.default_rng(7)
    pool = [*"ab é \u00a0|<>।क\u093e\u0947\u094dर\u0905\u093c\u200d\u200c\u200bа１ﬁ\u0301“x.\ufeff"]
    texts = ["".join(rnd.choice(pool, rnd.integers(0, 7))) for _ in range(20_000)] + ["", "plain words", "पद्\u200dमा"]
    cp, off = A.explode(pa.array(texts))
    same = A.plain(cp, off)
    out, to, _ = A.canonical(cp, off)
    got = A.implode(A.blank_tags(out, to), to).to_pylist()
    assert all(g == t for g, t, p in zip(got, texts, same, strict=True) if p)
    assert same[-3:].all() and 0.05 < same.mean() < 0.9
