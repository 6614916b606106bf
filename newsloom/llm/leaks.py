"""Problem 7: evaluation texts inside a corpus.

Texts are brought to templates: numbers, units and names become typed placeholders, where a name is
any word that few of the evaluation items have. Every run of ``window`` template words of the items
is hashed, and so is every run of the documents, of which only those go on whose hash a bitmap of the
items' hashes has. A hash join brings both together, and the slots are compared: if each slot holds
the same word on both sides, the passage stands in the document as it is; if every word of the item
is replaced by one and the same word wherever it occurs, and no two by the same, it is the item with
other parameters. A run with hardly a word beside its placeholders would fit anything; it takes part
with its own words instead of the placeholders, so that it can only be found as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .lineage import cut

WINDOW = 20
#: An item's words that at least so many items have are part of the template; the others are names.
SHARED = 3
#: A run is taken as a template if it has at least so many words that are no placeholders.
TOLD = 5
#: Bits of the bitmap of words that are part of templates, and of the one of the items' hashes: 512 kB and 4 MB, whatever the data.
#: Words or hashes that fall on one bit are taken for each other there, by items and documents alike; slots are compared in full.
WORD_BITS, KEY_BITS = 1 << 22, 1 << 25
#: Runs of items that a join may broadcast (some 200 bytes each); more of them are joined with a shuffle.
MOST_WINDOWS = 200_000
#: Units, which a template may vary with the number before them.
UNITS = "percent per cent km kilometre kilometres metre metres mile miles kg kilogram kilograms gram grams tonne tonnes litre litres hour hours minute minutes day days week weeks month months year years rupee rupees dollar dollars thousand lakh million crore billion हजार लाख करोड अर्ब किलोमिटर मिटर किलो टन घण्टा मिनेट दिन हप्ता महिना वर्ष रुपैयाँ प्रतिशत जना जनाको जनालाई"
NUMBER, UNIT, NAME = 101, 102, 103


def _words(col: pa.Array) -> A.Words:
    cp, off, _ = A.canonical(*A.explode(col))
    return A.Words(A.blank_tags(cp, off), off)


def _units() -> np.ndarray:
    cp, off = A.explode(pa.array([UNITS]))
    return np.unique(A.Words(cp, off).hash)


def windows(w: A.Words, shared: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of ``window`` words, and where it begins; ``shared`` is the bitmap of the templates' words."""
    if len(w) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    units = _units()
    digit = (A.table("kind")[w.low[w.start]] & 16) > 0
    unit = units[np.minimum(np.searchsorted(units, w.hash), len(units) - 1)] == w.hash
    bit = (w.hash % np.uint64(WORD_BITS)).astype(np.int64)
    known = (shared[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool) & ~digit & ~unit
    t = np.where(known, w.hash, np.uint64(NAME))
    t[unit] = UNIT
    t[digit] = NUMBER
    told = np.r_[0, np.cumsum(known)]
    at = np.flatnonzero(w.row[: len(w) - window + 1] == w.row[window - 1 :])
    template, _ = A.shingle(t, w.row, window)
    own, _ = A.shingle(w.hash, w.row, window)
    return np.where(told[at + window] - told[at] >= TOLD, template, own ^ np.uint64(1)), at


def _bits(keys: DataFrame, size: int) -> np.ndarray:
    """A bitmap of the numbers in the table's only column; at most ``size`` different ones reach the driver."""
    out = np.zeros(size, bool)
    for b in keys.toArrow().to_batches():
        out[b.column(0).to_numpy()] = True
    return np.packbits(out, bitorder="little")


def _shared_words(items: DataFrame, shared: int) -> np.ndarray:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "text"):
                w = _words(part.column("text"))
                row, bit = A.distinct(w.row, w.hash % np.uint64(WORD_BITS))
                u, n = np.unique(bit, return_counts=True)
                yield pa.record_batch([pa.array(u.astype(np.int64)), pa.array(n)], names=["bit", "n"])

    counted = A.over(items.select("text"), rows, "bit long, n long").groupBy("bit").agg(F.sum("n").alias("n"))
    return _bits(counted.where(F.col("n") >= shared).select("bit"), WORD_BITS)


def _runs(texts: DataFrame, id_col: str, shared: np.ndarray, window: int, only: np.ndarray | None) -> DataFrame:
    """(id, key, words) of the runs; with ``only``, a bitmap, those it lets through."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast((shared, only))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, may = held.value
        span = np.arange(window)
        for batch in batches:
            for part in A.slices(batch, "text"):
                w = _words(part.column("text"))
                key, at = windows(w, common, window)
                if may is not None:
                    bit = (key % np.uint64(KEY_BITS)).astype(np.int64)
                    let = (may[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                    key, at = key[let], at[let]
                if not len(key):
                    continue
                words = w.hash[at[:, None] + span].astype(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * window), pa.array(words))
                yield pa.record_batch([part.column(id_col).take(pa.array(w.row[at])), pa.array(key.astype(np.int64)), lists], names=["id", "key", "words"])

    return A.over(texts.select(F.col(id_col).cast("long").alias(id_col), "text").where(F.length("text") > 0), rows, "id long, key long, words array<long>")


def consistent(a: Column, b: Column) -> Column:
    """Whether each word of one run always stands for one word of the other."""
    pairs = F.size(F.array_distinct(F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))))
    return (pairs == F.size(F.array_distinct(a))) & (pairs == F.size(F.array_distinct(b)))


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, shared: int = SHARED, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, verbatim, windows): items found in documents; ``windows`` is how many runs of ``window`` words agree.

    ``documents`` has doc_id and text, ``items`` item_id and text; further columns are ignored. Null
    texts and texts shorter than the window have no row. Texts with one doc_id count as one document.
    There may be any number of items: up to ``most_windows`` of their runs are broadcast, more are
    joined with a shuffle, with the same result.
    """
    items = items.where(F.length("text") > 0)
    common = _shared_words(items, shared)
    sought = cut(_runs(items, "item_id", common, window, None).distinct(), "sought")
    few = sought.count() <= most_windows
    may = _bits(sought.select(F.pmod("key", F.lit(KEY_BITS)).alias("bit")).distinct(), KEY_BITS)
    found = _runs(documents, "doc_id", common, window, may).toDF("doc_id", "key", "wa")
    side = sought.toDF("item_id", "key", "wb")
    met = found.join(F.broadcast(side) if few else side, "key")
    met = met.withColumn("verbatim", F.col("wa") == F.col("wb")).where(F.col("verbatim") | consistent(F.col("wa"), F.col("wb")))
    return met.groupBy("doc_id", "item_id", "verbatim").agg(F.count("*").alias("windows"))
