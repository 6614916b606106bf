from __future__ import annotations

import os
import random
from collections import Counter

import pytest

from newsloom.llm import leaks as L
from newsloom.llm import subjects as S

ITEM = "item_id long, text string, lang string"
DOC = "doc_id long, text string, item_id long"
FRAME = "the mayor of {0} told {1} that {2} people would move to the new market near {0} before the rains and that {1} had {3} kilometres of road to mend in {4} this year"


def items(spark):
    names = [("Lorma", "Sulek", "40", "12", "Dovag"), ("Renmo", "Katim", "75", "9", "Tirak"), ("Bunal", "Nethor", "81", "30", "Mosun"), ("Phuren", "Chewi", "22", "7", "Zanub")]
    return spark.createDataFrame([(i, FRAME.format(*n), "en") for i, n in enumerate(names)] + [(9, None, "en"), (10, "too short", "en")], ITEM), names


def test_verbatim_and_with_other_parameters(spark):
    it, names = items(spark)
    text = FRAME.format(*names[0]).split()
    other = FRAME.format("Gorha", "Vesh", "611", "5", "Hinbu")
    mixed = FRAME.format("Gorha", "Vesh", "611", "5", "Hinbu").replace("near Gorha", "near Rilgo")
    docs = [
        (1, "Before it. " + " ".join(text[3:23]) + " After it.", 0), (2, "Before it. " + " ".join(text[3:22]) + " After it.", 0), (3, "<p>" + " ".join(text).upper().replace("THAT", "that,\n—") + "</p>", 0),
        (4, other, 0), (5, mixed, 0), (6, None, 0), (7, "", 0), (8, ("filler words go here " * 20_000) + " ".join(text), 0), (8, "nothing", 0),
    ]
    got = L.leaks(spark.createDataFrame(docs, DOC), it).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.verbatim} == {(1, 0), (3, 0), (8, 0)}
    assert {r.item_id for r in got if r.doc_id == 4 and not r.verbatim} == {0, 1, 2, 3}
    assert not [r for r in got if r.doc_id == 5 and r.windows > 15]
    assert next(r.windows for r in got if r.doc_id == 1) == 1


def test_random_passages_against_brute_force(spark):
    rnd = random.Random(0)
    words = [f"w{i}" for i in range(80)]
    its = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(10, 50))), "x") for i in range(12)]
    docs = []
    for d in range(60):
        t = [rnd.choice(words) for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(3)):
            src = rnd.choice(its)[1].split()
            a = rnd.randrange(len(src))
            k = rnd.randrange(len(t) + 1)
            t[k:k] = src[a : a + rnd.randrange(15, 30)]
        docs.append((d, " ".join(t), 0))
    want = set()
    for d, t, _ in docs:
        w = t.split()
        runs = {tuple(w[i : i + 20]) for i in range(len(w) - 19)}
        for i, x, _ in its:
            v = x.split()
            if any(tuple(v[k : k + 20]) in runs for k in range(len(v) - 19)):
                want.add((d, i))
    got = L.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(its, ITEM)).where("verbatim")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_nothing_to_find(spark):
    it, _ = items(spark)
    assert L.leaks(spark.createDataFrame([], DOC), it).count() == 0
    assert L.leaks(spark.createDataFrame([(1, "text", 0)], DOC), it.limit(0)).count() == 0


TOPICS = {
    "sport": ["match", "goal", "team", "coach", "league", "striker"],
    "law": ["court", "judge", "bill", "statute", "verdict", "appeal"],
    "health": ["clinic", "nurse", "fever", "vaccine", "ward", "doctor"],
}


def sentence(rnd, topic):
    w = [rnd.choice(TOPICS[topic]) for _ in range(5)]
    return f"The {w[0]} and the {w[1]} in Town{rnd.randrange(9999)} led to a {w[2]} with {w[3]} over {w[4]}."


def neutral(rnd):
    return f"More details are due in {rnd.randrange(99)} days said Name{rnd.randrange(9999)}."


def corpora(seed, n=300):
    rnd = random.Random(seed)
    examples = [(i, t, " ".join(sentence(rnd, t) for _ in range(2))) for i, t in enumerate(list(TOPICS) * 15)]
    examples[0] = (0, "law", examples[0][2])  # a wrong label
    docs, truth = [], {}
    for d in range(n):
        main = rnd.sample(list(TOPICS), rnd.choice([1, 1, 2]))
        s = [sentence(rnd, t) for t in main for _ in range(4)] + [neutral(rnd) for _ in range(rnd.randrange(6))]
        rest = [t for t in TOPICS if t not in main]
        if len(main) == 1 and rnd.random() < 0.5:
            s.append(sentence(rnd, rest[0]))  # in passing
        rnd.shuffle(s)
        docs.append((d, f"{rnd.choice(TOPICS[rest[-1]])} headline in Town\n" + " ".join(s) + "\nShare this story | Print", "x"))
        truth[d] = set(main)
    return examples, docs, truth


def test_subjects_of_held_out_documents(spark):
    examples, docs, truth = corpora(0)
    ex = spark.createDataFrame(examples, "example_id long, subject string, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    out = S.document_subjects(df, ex)
    got: dict[int, set] = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(d) == truth[d] for d in truth)
    assert right >= 0.95 * len(truth)
    comp = S.composition(out).collect()
    assert abs(sum(r.share for r in comp) - 1) < 1e-4 and {r.subject for r in comp} == set(TOPICS)


def test_odd_documents(spark):
    examples, docs, _ = corpora(1, 40)
    ex = spark.createDataFrame([*examples, (900, None, "text"), (901, "law", None)], "example_id long, subject string, text string")
    odd = [(1000, None, ""), (1001, "", ""), (1002, "...", ""), (1003, sentence(random.Random(3), "law") * 3000, "")]
    out = S.document_subjects(spark.createDataFrame([*docs, *odd], "doc_id long, text string, subject string"), ex)
    assert {r.doc_id: r.subject for r in out.where("doc_id >= 1000").collect()} == {1003: "law"}
    assert S.document_subjects(spark.createDataFrame([], "doc_id long, text string"), ex).count() == 0
    with pytest.raises(ValueError, match="two subjects"):
        S.train(ex.where("subject = 'law'"), spark.createDataFrame([], "doc_id long, text string"))


def test_a_bounded_sample_has_all_subjects(spark, monkeypatch):
    from newsloom.llm import subjects

    monkeypatch.setattr(subjects, "MOST_EXAMPLES", 40)
    rows = [(s, f"The {w} of place {i} was {w} again.") for s, w in (("business", "market"), ("world", "treaty")) for i in range(60)]
    model = subjects.train(spark.createDataFrame(rows, "subject string, text string"), spark.createDataFrame([], "doc_id long, text string"))
    assert model.subjects == ["business", "world"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_items_with_other_names_and_figures_are_found(spark):
    """Recall of re-parameterised items: each word that few items have is replaced by one other word, each figure by another."""
    items = spark.read.parquet("/root/testdata/sf0.001/eval_items.parquet").select("item_id", "text")
    rows = items.collect()
    often = Counter(w for r in rows for w in {x.strip(".,;:?!।“”\"'()").lower() for x in r.text.split()})
    docs, templates = [], set()
    for r in rows:
        new, told = [], []
        for x in r.text.split():
            core = x.strip(".,;:?!।“”\"'()")
            if core and any(c.isdigit() for c in core):
                new.append(x.replace(core, str(7 + len(core) * 13)))
            elif core and often[core.lower()] < L.SHARED and core.lower() not in L.UNITS.split():
                new.append(x.replace(core, "qo" + core.lower()[::-1]))
            else:
                new.append(x)
                told.append(len(new) - 1)
        docs.append((r.item_id, "Before it. " + " ".join(new), 0))
        told = set(told)
        if any(sum(j in told for j in range(i, i + 20)) >= L.TOLD + 1 for i in range(len(new) - 19)):
            templates.add(r.item_id)
    got = L.leaks(spark.createDataFrame(docs, DOC), items)
    found = {r.doc_id for r in got.where("NOT verbatim AND doc_id = item_id").collect()}
    assert len(templates) >= 0.5 * len(rows)
    assert len(found & templates) >= 0.9 * len(templates)


def test_joined_with_a_shuffle_or_broadcast_is_the_same(spark):
    it, names = items(spark)
    docs = spark.createDataFrame([(i, "x " * i + FRAME.format(*names[i % 4]), 0) for i in range(8)] + [(20, FRAME.format("Gorha", "Vesh", "611", "5", "Hinbu"), 0)], DOC)
    one, two = (sorted(map(tuple, L.leaks(docs, it, most_windows=n).collect())) for n in (L.MOST_WINDOWS, 0))
    assert one == two and len(one) > 8


def test_runs_of_placeholders_only_match_as_they_are(spark):
    """Items that share no words: with placeholders alone every run would fit every other."""
    rnd = random.Random(8)
    its = [(i, " ".join(f"n{rnd.randrange(10**6)}x" for _ in range(40)), "x") for i in range(30)]
    docs = [(i, t, 0) for i, t, _ in its[:10]] + [(99, " ".join(f"m{i}y" for i in range(400)), 0)]
    got = L.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(its, ITEM), shared=10).collect()
    assert {(r.doc_id, r.item_id, r.verbatim) for r in got} == {(i, i, True) for i in range(10)}
