from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from newsloom.llm import packing as K

SCHEMA = "doc_id long, source string, tokens long, place string"


def check(rows, sizes, capacity):
    by, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.container].append((r.place, r.tokens))
        pieces[r.doc_id].append((r.first_token, r.tokens, r.piece))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and sum(n for _, n in spans) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    for d, n in sizes.items():
        got = sorted(pieces.pop(d, []))
        assert sum(x[1] for x in got) == n and [x[2] for x in got] == list(range(len(got)))
        assert len(got) == (0 if n == 0 else -(-n // capacity))
        assert all(a + x == b for (a, x, _), (b, *_) in zip(got, got[1:]))
    assert not pieces
    return 1 - sum(sizes.values()) / (len(by) * capacity) if by else 0


@pytest.mark.parametrize(("part", "fan"), [(50_000, 16), (120, 2)])
@pytest.mark.parametrize("capacity", [64, 500])
def test_everything_has_a_place(spark, capacity, part, fan):
    rnd = random.Random(capacity)
    sizes = {i: int(rnd.expovariate(1 / 90)) for i in range(1500)}
    df = spark.createDataFrame([(i, "big" if i % 3 else f"s{i % 5}", n, "x") for i, n in sizes.items()], SCHEMA)
    rows = K.pack(df, capacity, window=8, part=part, fan=fan).collect()
    assert check(rows, sizes, capacity) < (0.02 if capacity == 500 else 0.2)


def test_mixture_follows_the_targets(spark):
    rnd = random.Random(1)
    sizes = {i: rnd.randrange(5, 60) for i in range(4000)}
    source = {i: ["a", "b", "c", None][min(3, int(rnd.random() ** 2 * 5))] for i in sizes}
    df = spark.createDataFrame([(i, source[i], n, "") for i, n in sizes.items()], SCHEMA)
    rows = K.pack(df, 400, window=8).collect()
    check(rows, sizes, 400)
    total = sum(sizes.values())
    share = {s: sum(n for i, n in sizes.items() if source[i] == s) / total for s in ("a", "b", "c", None)}
    windows = defaultdict(lambda: defaultdict(int))
    for r in rows:
        windows[int(r.container.split("-")[2]) // 8][source[r.doc_id]] += r.tokens
    for w, mix in list(windows.items())[:-1]:
        for s, want in share.items():
            assert abs(mix[s] / sum(mix.values()) - want) < 0.06, (w, s)


def test_every_source_has_its_own_queue(spark):
    sizes = {i: 5 + i % 20 for i in range(300)}
    source = {i: "big" if i % 2 else (f"s{i}" if i % 5 else None) for i in sizes}
    df = spark.createDataFrame([(i, source[i], n, "") for i, n in sizes.items()], SCHEMA)
    check(K.pack(df, 100, window=4).collect(), sizes, 100)
    check(K.pack(df, 100, targets={"big": 0.7, None: 0.2, "s2": 0.1, "unheard": 0.5}, window=4, part=50, fan=2).collect(), sizes, 100)


@pytest.mark.parametrize(("low", "high"), [(1100, 1900), (600, 900), (200, 2000)])
def test_what_is_left_over_is_bounded(low, high):
    """Lengths of 0.3 to 0.9 of the capacity, which fit together badly: a partition leaves a window and CARRY containers at most."""
    rnd = np.random.default_rng(low)
    for n in (5_000, 20_000):
        size = rnd.integers(low, high, n)
        box, place, used = K.fill(size, np.zeros(n, np.int64), np.ones(1), np.zeros(1), 2048, K.WINDOW, False)
        assert size[box < 0].sum() <= (K.WINDOW + K.CARRY) * 2048
        held = np.bincount(box[box >= 0], weights=size[box >= 0], minlength=used)
        assert (held <= 2048).all() and (held > 0).all()
        assert used <= -(-n // (2048 // high))  # so many of the longest fit into one


def test_hard_lengths_in_many_partitions(spark):
    rnd = random.Random(3)
    sizes = {i: rnd.randrange(1100, 1900) for i in range(4000)}
    df = spark.createDataFrame([(i, f"s{i % 7}", n, "") for i, n in sizes.items()], SCHEMA)
    rows = K.pack(df, 2048, window=8, part=500, fan=2).collect()
    check(rows, sizes, 2048)
    assert len({r.container for r in rows}) == len(sizes)  # no two fit together


def test_limits(spark):
    rows = [(1, None, 0, ""), (2, "s", None, ""), (3, "s", 10, ""), (4, "s", 25, ""), (5, None, 3, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = K.pack(df, 10).collect()
    check(got, {3: 10, 4: 25, 5: 3}, 10)
    assert K.pack(df.limit(0), 10).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        K.pack(df, 0)


def test_tokens(spark):
    ranks = K.tokenizer_file()
    df = spark.createDataFrame([(1, "s", "hello world", 1), (2, None, "", 1), (3, "s", None, 1), (4, "s", "<|endoftext|> नेपाल", 1)], "doc_id long, source string, text string, tokens int")
    got = {r.doc_id: r.tokens for r in K.token_counts(df, ranks).collect()}
    assert set(got) == {1, 4} and got[1] in (2, 3) and got[4] > 3
