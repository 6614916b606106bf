"""Problem 8: subject areas of documents.

A complement naive Bayes classifier is trained on labelled examples, sentence by sentence, then
refined by expectation-maximization over the sentences of all documents: each round classifies every
sentence with the current weights and adds its words to the counts of the subjects in proportion.
Words that too few documents have carry no weight. A logistic curve per subject, fitted on labelled
sentences that the fold's classifier has not seen, turns scores into independent posteriors. A
document has the subjects that enough of its sentences are about.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..ship import ship
from . import arrowtext as A

#: Words are counted in so many cells.
CELLS = 1 << 16
ALPHA = 0.5
#: A cell has a weight if at least this share of all documents has one of its words.
LEAST_SHARE = 0.002
ROUNDS = 2
#: Share of a document's sentences that treat any subject.
ENOUGH = 0.3
#: A sentence treats a subject if its posterior lies by so much of the way above that of a sentence which says nothing.
TREATS = 0.2
#: Words of a line without an end mark, up to which it is a headline, byline or footer.
LINE = 20
#: Words of a sentence and of one that must be several run together.
USUAL, LONG = 20, 45
#: Most labelled rows that are fitted on; the classifier is trained on the driver.
MOST_EXAMPLES = 100_000
FOLDS = 5
#: Weight of a labelled sentence against one of the corpus in the rounds of refinement.
LABELLED = 10.0


@dataclass
class Model:
    subjects: list[str]
    weight: np.ndarray  # CELLS x subjects
    slope: np.ndarray
    offset: np.ndarray

    def posteriors(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _margin(score) + self.offset, -40, 40)))


    def evidence(self, score: np.ndarray) -> np.ndarray:
        """By sentence and subject, how far the posterior lies above that of a sentence without a word that tells; 0 to 1."""
        none = 1 / (1 + np.exp(-self.offset))
        return np.clip((self.posteriors(score) - none) / (1 - none), 0, 1)


def _margin(score: np.ndarray) -> np.ndarray:
    """How far each subject's score is above the best of the others."""
    order = np.sort(score, 1)
    best, second = order[:, -1:], order[:, -2:-1]
    return np.where(score == best, score - second, score - best)


def sentences(texts: pa.Array, lines: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cell and sentence of each word; row of each sentence; their number). With ``lines``, headlines, bylines and footers are left out."""
    cp, off, _ = A.canonical(*A.explode(texts))
    tagged = A.blank_tags(cp, off)
    kind = A.table("kind")[cp]
    n = len(cp)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0
    after = np.ones(n, bool)
    after[:-1] = ((kind[1:] & 1) > 0) | ((kind[1:] & 2) > 0) | (cp[1:] == 0x3C)
    stop = ((kind & 32) > 0) & after
    line = (cp == 0x0A) | ((tagged != cp) & (cp == 0x3E))
    cut_ = stop | line | (cp == 0x3B)
    begin = np.zeros(n + 1, bool)
    begin[1:] = cut_
    begin[off[:-1]] = True
    seg = np.cumsum(begin[:n]) - 1
    m = int(seg[-1]) + 1
    w = A.Words(tagged, off)
    ws = seg[w.start]
    size = np.bincount(ws, minlength=m)
    ended = np.zeros(m, bool)
    ended[seg[stop | (cp == 0x3B)]] = True
    row = np.zeros(m, np.int64)
    row[ws] = w.row
    keep = size > 0
    if lines:
        keep &= ended | (size > LINE)
    # run-on sentences, cut to about the usual length
    place = np.arange(len(ws)) - np.searchsorted(ws, ws)
    parts = np.where(size > LONG, np.round(size / USUAL), 1).astype(np.int64)
    sub = np.minimum(place * parts[ws] // np.maximum(size[ws], 1), parts[ws] - 1)
    base = np.cumsum(np.where(keep, parts, 0)) - np.where(keep, parts, 0)
    use = keep[ws]
    sent = (base[ws] + sub)[use]
    rows = np.repeat(row[keep], parts[keep])
    digit = (A.table("kind")[w.low[w.start]] & 16) > 0
    cell = (w.hash & np.uint64(CELLS - 1)).astype(np.int64)[use]
    real = ~digit[use]
    return cell[real], sent[real], rows, len(rows)


def _scores(weight: np.ndarray, cell: np.ndarray, sent: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, weight.shape[1]))
    if len(cell):
        starts = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]])
        out[sent[starts]] = np.add.reduceat(weight[cell], starts, axis=0)
    return out


def _weights(counts: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Complement naive Bayes: how little a word belongs to the other subjects; cells that aren't known have none."""
    counts = np.where(known[:, None], counts, 0)
    rest = counts.sum(1, keepdims=True) - counts + ALPHA
    w = -np.log(rest / rest.sum(0))
    w -= w.mean(1, keepdims=True)
    return np.where(known[:, None], w, 0.0)


def _counts(cell: np.ndarray, sent: np.ndarray, share: np.ndarray) -> np.ndarray:
    out = np.zeros((CELLS, share.shape[1]))
    for c in range(share.shape[1]):
        out[:, c] = np.bincount(cell, weights=share[sent, c], minlength=CELLS)
    return out


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve: Newton's method with smoothed targets, a little shrinkage and halved steps."""
    scale = max(float(np.abs(x).mean()), 1e-9)
    x = x / scale
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((np.logaddexp(0, z) - t * z).sum() + 0.5 * a * a)

    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        v = p * (1 - p) + 1e-6
        g = np.array([((p - t) * x).sum() + a, (p - t).sum()])
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        now = loss(a, b)
        while loss(a - step[0], b - step[1]) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)) / scale, float(b)


def _share(model: Model, cell: np.ndarray, sent: np.ndarray, n: int) -> np.ndarray:
    """Each sentence's part in the subjects; as far as it treats none, it counts for all alike, so that its words stay without weight."""
    score = _scores(model.weight, cell, sent, n)
    p = np.exp((score - score.max(1, keepdims=True)) * model.slope.mean())
    top = model.evidence(score).max(1, keepdims=True)
    return p / p.sum(1, keepdims=True) * top + (1 - top) / p.shape[1]


def _corpus_counts(documents: DataFrame, model: Model) -> np.ndarray:
    """By cell: documents that have it, then expected words of each subject; summed in the tasks, CELLS rows reach the driver."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    subjects = len(model.subjects)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CELLS, subjects + 1))
        w = held.value
        for batch in batches:
            for part in A.slices(batch, "text"):
                cell, sent, row, n = sentences(part.column("text"), True)
                if not n:
                    continue
                pair = np.unique(row[sent] * CELLS + cell) % CELLS
                total[:, 0] += np.bincount(pair, minlength=CELLS)
                total[:, 1:] += _counts(cell, sent, _share(w, cell, sent, n))
        at = np.flatnonzero(total[:, 0])
        yield pa.record_batch([pa.array(at), pa.FixedSizeListArray.from_arrays(pa.array(total[at].reshape(-1)), subjects + 1).cast(pa.list_(pa.float64()))], names=["cell", "x"])

    ship(documents.sparkSession)
    parts = documents.select("text").where(F.length("text") > 0).mapInArrow(rows, "cell long, x array<double>")
    sums = parts.groupBy("cell").agg(*[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(subjects + 1)]).toArrow()
    out = np.zeros((CELLS, subjects + 1))
    if sums.num_rows:
        out[sums["cell"].to_numpy()] = np.stack([sums[f"x{i}"].to_numpy() for i in range(subjects + 1)], 1)
    return out


def train(examples: DataFrame, documents: DataFrame, rounds: int = ROUNDS) -> Model:
    """The classifier, from labelled examples (subject, text) and the texts of all documents; null texts and labels are left out."""
    rows = examples.where("subject IS NOT NULL AND length(text) > 0").select("subject", "text").orderBy(F.xxhash64("text"), "subject", "text").limit(MOST_EXAMPLES).orderBy("subject", "text").toArrow()
    labels = rows["subject"].to_pylist()
    subjects = sorted(set(labels))
    if len(subjects) < 2:
        raise ValueError("examples of two subjects at least are needed")
    y = np.array([subjects.index(x) for x in labels])
    cell, sent, row, n = sentences(rows["text"].combine_chunks(), False)
    own = np.eye(len(subjects))[y[row]]
    labelled = _counts(cell, sent, own)
    n_docs = documents.where(F.length("text") > 0).count()
    fold = np.arange(len(y)) % FOLDS
    np.random.default_rng(0).shuffle(fold)

    def model(corpus: np.ndarray, known: np.ndarray) -> Model:
        score = np.zeros((n, len(subjects)))
        for k in range(FOLDS):  # a fold's sentences are scored without their own labels
            there = fold[row] == k
            use = ~there[sent]
            counts = corpus + LABELLED * _counts(cell[use], sent[use], own)
            score[there] = _scores(_weights(counts, known & (counts.sum(1) > 0)), cell, sent, n)[there]
        margin = _margin(score)
        curves = [_curve(margin[:, c], y[row] == c) for c in range(len(subjects))]
        return Model(subjects, _weights(corpus + LABELLED * labelled, known), np.array([a for a, _ in curves]), np.array([b for _, b in curves]))

    out = model(np.zeros((CELLS, len(subjects))), labelled.sum(1) > 0)
    for _ in range(rounds if n_docs else 0):
        got = _corpus_counts(documents, out)
        out = model(got[:, 1:], got[:, 0] >= max(2, LEAST_SHARE * n_docs))
    return out


def sentence_counts(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, n, total, posterior): for each subject that a sentence treats, how many do, how many treat any, and the mean posterior over those."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = len(m.subjects)
        for batch in batches:
            for part in A.slices(batch, "text"):
                cell, sent, row, n = sentences(part.column("text"), True)
                if not n:
                    continue
                score = _scores(m.weight, cell, sent, n)
                p = m.posteriors(score)
                best = score.argmax(1)
                treats = m.evidence(score)[np.arange(n), best] >= TREATS
                key = row[treats] * k + best[treats]
                u, inv, count = np.unique(key, return_inverse=True, return_counts=True)
                total = np.bincount(row[treats], minlength=part.num_rows)
                mean = np.bincount(inv, weights=p[treats, best[treats]], minlength=len(u)) / np.maximum(count, 1)
                yield pa.record_batch([part.column("doc_id").take(pa.array(u // k)), pa.array([m.subjects[i] for i in u % k], pa.string()), pa.array(count), pa.array(total[u // k]), pa.array(mean)], names=["doc_id", "subject", "n", "total", "posterior"])

    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0).mapInArrow(rows, "doc_id long, subject string, n long, total long, posterior double")


def document_subjects(documents: DataFrame, examples: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """(doc_id, subject, share): the subjects of each document.

    Documents with null or empty texts, or without a sentence on any subject, have no row; documents
    are told apart by doc_id, which must be unique. Further columns are ignored.
    """
    share = F.col("n") / F.col("total")
    return sentence_counts(documents, train(examples, documents)).where(F.col("n") >= F.col("total") * enough - 1e-9).select("doc_id", "subject", share.alias("share"))


def composition(subjects: DataFrame) -> DataFrame:
    """(subject, documents, share): documents of each subject, and its share of all subjects' documents, each counted by its part of the document."""
    parts = subjects.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("share").alias("w"))
    whole = F.sum("w").over(Window.partitionBy())  # one row for each subject
    return parts.select("subject", "documents", F.round(F.col("w") / whole, 6).alias("share"))
