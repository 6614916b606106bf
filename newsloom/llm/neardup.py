"""Problem 3: near-duplicate records with small edits.

Every text becomes the set of its word shingles, every set a SuperMinHash signature: each element
walks its own random permutation of the m components, so that its ranks in them are correlated
(each of 0..m-1 once) and the signature has less variance than MinHash; all elements of a chunk walk
in step, and a text stops as soon as each of its components is set, since a later step could only
bring larger values. Bands of the signature give candidate pairs, the sets verify them, and
union-find groups what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrowtext as A
from .components import components
from .lineage import cut

ROWS, BANDS = 4, 64
#: Texts that share a band are compared directly up to so many; more of them are joined on rare shingles instead.
HOT = 200
#: Classes that a task remembers having written; a copy of an older one is merged only after the shuffle.
REMEMBERED = 100_000


def superminhash(row: np.ndarray, h: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures of n sets, whose elements are the hashes ``h`` of rows ``row`` (ordered); m at most 65,536.

    A component holds (step << 32 | random) of the smallest element; sets without elements hold the
    largest number in every component.
    """
    sig = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    kind = np.uint8 if m <= 256 else np.uint16
    perm = np.broadcast_to(np.arange(m, dtype=kind), (len(h), m)).copy().reshape(-1)
    at = np.arange(len(h), dtype=np.int64) * m
    base = row * m
    seed = h
    for j in range(m):
        if not len(at):
            break
        x = A.mix(seed + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        mine = perm[at + k]
        perm[at + k] = perm[at + j]
        value = np.uint64(j << 32) | x >> np.uint64(32)
        np.minimum.at(sig, base + mine, value)
        if j % 4 == 3 or m - j < 4:  # looking each time would cost more than the few steps it saves
            open_ = (sig.reshape(n, m) == np.iinfo(np.uint64).max).any(1)
            go = open_[base // m]
            if not go.all():
                at, base, seed = at[go], base[go], seed[go]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:2]).copy()
    for r in range(rows):
        acc = acc * np.uint64(0x100000001B3) + part[:, :, r]
    return A.mix(acc).astype(np.int64)


def _sets(part: pa.RecordBatch, columns: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each row (row, hash), and a hash of each row's set."""
    cp, off = A.concat([A.explode(part.column(c)) for c in columns])
    cp, off, _ = A.canonical(cp, off)
    w = A.Words(A.blank_tags(cp, off), off)
    h, row = w.shingles(k)
    row, h = A.distinct(row, h)
    n = part.num_rows
    size = np.bincount(row, minlength=n)
    acc = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(A.mix(h), out=acc[1:])  # the sum of a set's hashes doesn't depend on their order
    at = np.searchsorted(row, np.arange(n + 1))
    cls = A.mix(acc[at[1:]] - acc[at[:-1]] + size.astype(np.uint64)).astype(np.int64)
    return row, h, cls


def signatures(df: DataFrame, id_col: str, columns: list[str], k: int, bands: int, rows: int) -> DataFrame:
    """(id, cls, keys, sketch, shingles) of each text with a shingle; the last three once for each class and task.

    Copies of a text are so merged before any shuffle. ``sketch`` has the lowest bit of each
    component of the signature, ``shingles`` the set itself, hashed to 32 bits.
    """
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.int64)
        for batch in batches:
            for part in A.slices(batch, *columns):
                row, h, cls = _sets(part, columns, k)
                n = part.num_rows
                has = np.bincount(row, minlength=n) > 0
                _, first = np.unique(cls, return_index=True)
                new = np.zeros(n, bool)
                new[first] = True
                new &= has & ~np.isin(cls, seen)
                seen = np.r_[seen, cls[new]][-REMEMBERED:]
                number = np.cumsum(new) - 1
                own = new[row]
                sig = superminhash(number[row[own]], h[own], int(new.sum()), m)
                keys = band_keys(sig, bands, rows).reshape(-1)
                bits = np.packbits((sig & np.uint64(1)).astype(bool), axis=1)
                bits = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.int64)
                held = new[has]
                at = np.r_[0, np.cumsum(held)]
                size = np.bincount(number[row[own]], minlength=int(new.sum()))
                ends = np.r_[0, np.cumsum(size)]

                def lists(values: np.ndarray, off: np.ndarray, held: np.ndarray = held) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values), mask=pa.array(~held))

                yield pa.record_batch(
                    [part.column(id_col).filter(pa.array(has)), pa.array(cls[has]), lists(keys, at * bands), lists(bits.reshape(-1), at * bits.shape[1]), lists((h[own] >> np.uint64(32)).astype(np.uint32).view(np.int32), ends[at])],
                    names=["id", "cls", "keys", "sketch", "shingles"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return A.over(df.select(id_col, *columns), run, f"id {kind}, cls long, keys array<long>, sketch array<long>, shingles array<int>")


#: Classes that a join may broadcast; above, both sides are shuffled.
SMALL = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def similar_classes(signed: DataFrame, threshold: float, bands: int, rows: int, hot: int = HOT) -> DataFrame:
    """(a, b, similarity) of the classes whose sets are at least ``threshold`` alike; a < b.

    A pair that shares a band is first judged by its sketches: of m bits, two sets of similarity J
    agree in m(1+J)/2 on average, so a pair five standard deviations below that for the threshold
    is none (one in three million true ones is lost so); then by its sets.
    """
    m = bands * rows
    spread = signed.where("keys IS NOT NULL").select("cls", F.explode("keys").alias("key"))
    together = spread.repartition("key").dropDuplicates(["key", "cls"]).withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    together = cut(together, "bands")
    few = together.where(F.col("n") <= hot)
    pairs = few.alias("a").join(few.alias("b"), "key").where("a.cls < b.cls").select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()
    sketches = signed.where("sketch IS NOT NULL").select("cls", "sketch").dropDuplicates(["cls"])
    xa, xb = sketches.select(F.col("cls").alias("a"), F.col("sketch").alias("x")), sketches.select(F.col("cls").alias("b"), F.col("sketch").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    agree = (1 + threshold) / 2
    most = m * (1 - agree) + 5 * (m * agree * (1 - agree)) ** 0.5
    pairs = cut(pairs.join(xa, "a").join(xb, "b").where(apart <= most).select("a", "b"), "candidates")
    many = together.where(F.col("n") > hot).select("cls").distinct()
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).union(many).distinct()
    sets = cut(signed.where("shingles IS NOT NULL").select("cls", "shingles").join(_small(needed), "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    if not many.isEmpty():  # exact for those: two sets this alike share one of their rarest shingles
        crowd = sets.join(many, "cls", "left_semi")
        each = crowd.select("cls", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
        each = each.join(each.groupBy("s").agg(F.count("*").alias("df")), "s")
        order = F.row_number().over(Window.partitionBy("cls").orderBy("df", "s"))
        prefix = each.withColumn("i", order).where(F.col("i") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1).select("cls", "s")
        more = prefix.alias("a").join(prefix.alias("b"), "s").where("a.cls < b.cls").select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"))
        pairs = pairs.unionByName(more).distinct()
    a = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").withColumn("both", both).select("a", "b", (F.col("both") / (F.size("sa") + F.size("sb") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicate_pairs(df: DataFrame, id_col: str, columns: list[str], k: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, hot: int = HOT) -> DataFrame:
    """(id_a, id_b) of all near-duplicates, copies included; id_a < id_b.

    A row whose texts are null, empty or shorter than k words has no partner. An id given twice
    counts as one. The number of rows is that of the pairs there are.
    """
    signed = cut(signatures(df, id_col, columns, k, bands, rows), "signatures")
    members = signed.select("id", "cls").distinct()
    links = cut(similar_classes(signed, threshold, bands, rows, hot), "links").select("a", "b")
    same = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    both = _small(cut(links.unionByName(same), "pairs"))
    ma = members.select(F.col("cls").alias("a"), F.col("id").alias("x"))
    mb = members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    half = cut(ma.join(both, "a"), "half")
    out = mb.join(_small(half), "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, columns: list[str], k: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, hot: int = HOT) -> DataFrame:
    """(id, group_id, links): each row's group, named by the least class in it, and how many classes its class is linked with.

    Rows without a shingle have a group of their own (null).
    """
    signed = cut(signatures(df, id_col, columns, k, bands, rows), "signatures")
    members = signed.select("id", "cls").distinct()
    links = cut(similar_classes(signed, threshold, bands, rows, hot), "links").select("a", "b")
    group = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    out = members.join(group, members.cls == group.node, "left").join(degree, "cls", "left")
    out = out.select("id", F.coalesce("component", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return df.select(F.col(id_col).alias("id")).distinct().join(out, "id", "left").select("id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def news_texts(articles: DataFrame, residue: DataFrame, least: int = 120) -> DataFrame:
    """(id, title, summary) of the articles that take part: no residue, and a summary of at least ``least`` characters."""
    bad = residue.where("table_name = 'articles'").select(F.col("row_key").alias("id"))
    return articles.where(F.length("summary") >= least).select("id", "title", "summary").join(bad, "id", "left_anti")
