from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from newsloom.llm import components as C
from newsloom.llm import forms
from newsloom.llm import neardup as N

SCHEMA = "id string, title string, summary string, cls long, keys string"


def corpus(seed, n=40):
    rnd = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            t = rnd.choice(rows)[2].split()
            for _ in range(rnd.randrange(6)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            if rnd.random() < 0.3:
                k = rnd.randrange(len(t))
                t = t[k:] + t[:k]
        else:
            t = [rnd.choice(words) for _ in range(rnd.randrange(20, 60))]
        rows.append((f"r{i:02}", "head", " ".join(t), i, "x"))
    return rows


def sets(rows, k):
    out = {}
    for r in rows:
        w = f"{r[1] or ''} {r[2] or ''}".lower().split()
        out[r[0]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return out


def brute(rows, k, threshold):
    s = sets(rows, k)
    return {(a, b) for a, b in itertools.combinations(sorted(s), 2) if s[a] and s[b] and len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}


@pytest.mark.parametrize(("seed", "k", "threshold"), [(0, 3, 0.5), (1, 3, 0.5), (2, 5, 0.8)])
@pytest.mark.parametrize("hot", [200, 1])
def test_pairs_are_those_of_brute_force(spark, seed, k, threshold, hot):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id_a, r.id_b) for r in N.near_duplicate_pairs(df, "id", ["title", "summary"], k, threshold, hot=hot).collect()}
    want = brute(rows, k, threshold)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_groups(spark):
    rows = corpus(3)
    pairs = brute(rows, 3, 0.5)
    got = {r.id: r.group_id for r in N.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), "id", ["title", "summary"], 3, 0.5).collect()}
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    for a, b in itertools.combinations(parent, 2):
        assert (got[a] == got[b]) == (root(a) == root(b))


def test_edges_cases(spark):
    rows = [("a", None, None, 1, ""), ("b", "", "", 1, ""), ("c", "one two", "", 1, ""), ("d", "One two three", "four", 1, ""), ("e", "one, two", "<p>three</p> four", 1, ""), ("e", "one, two", "three four", 1, ""), ("f", "ｏｎｅ two", "three four!", 1, ""), ("g", "long", "w x y z " * 20_000, 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id_a, r.id_b) for r in N.near_duplicate_pairs(df, "id", ["title", "summary"], 3, 0.5).collect()}
    assert got == {("d", "e"), ("d", "f"), ("e", "f")}
    groups = N.near_duplicate_groups(df, "id", ["title", "summary"], 3, 0.5).collect()
    assert len({r.id for r in groups}) == 7 and {r.id for r in groups if r.group_id is None} == {"a", "b", "c"}
    assert N.near_duplicate_pairs(df.limit(0), "id", ["title", "summary"]).count() == 0


def test_superminhash_estimates_similarity_better_than_minhash():
    rng = np.random.default_rng(0)
    m, n, error = 64, 60, []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 90, dtype=np.int64).astype(np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[30:])  # 30 of 90 are shared
        sig = N.superminhash(np.repeat([0, 1], n), np.r_[a, b], 2, m)
        assert (sig < np.iinfo(np.uint64).max).all()
        error.append((sig[0] == sig[1]).mean() - 1 / 3)
    plain = (1 / 3 * 2 / 3 / m) ** 0.5
    assert abs(np.mean(error)) < 0.02 and np.std(error) < plain


def test_superminhash_is_the_plain_algorithm():
    rng = np.random.default_rng(1)
    m = 16
    for size in (1, 2, 7, 40):
        h = np.sort(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64))
        want = [None] * m
        for e in h.tolist():
            p = list(range(m))
            for j in range(m):
                x = int(N.A.mix(np.array([(e + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
                k = j + ((x & 0xFFFFFFFF) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                v = (j << 32) | (x >> 32)
                want[p[j]] = v if want[p[j]] is None else min(want[p[j]], v)
        assert N.superminhash(np.zeros(size, np.int64), h, 1, m)[0].tolist() == want


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r.node: r.component for r in C.components(df).collect()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in parent if x not in loops}


def test_forms(spark):
    df = spark.createDataFrame([("a", "ｆｕｌｌ", None, 1), ("b", "fine", "cát", 2), ("c", None, "", 3), ("c", None, "", 3)], "id string, title string, summary string, field long")
    out = {r.id: r for r in forms.to_one_form(df, ["title", "summary"]).collect()}
    assert (out["a"].title, out["a"].summary, out["a"].changed_fields, out["a"].field) == ("full", None, ["title"], 1)
    assert (out["b"].summary, out["b"].changed_fields) == ("cát", ["summary"])
    assert (out["c"].title, out["c"].summary, out["c"].changed_fields) == (None, "", [])
    residue = spark.createDataFrame([("articles", "b")], "table_name string, row_key string")
    assert [(r.article_id, r.field) for r in forms.changed_fields(df, residue).collect()] == [("a", "title")]
    with pytest.raises(ValueError, match="already"):
        forms.to_one_form(df.withColumnRenamed("field", "changed_fields"), ["title"])
    assert forms.to_one_form(df.limit(0), ["title"]).count() == 0
