"""Problem 4: new batches against all history.

A ``History`` is a folder with the tables ``keys`` (fingerprint; for a title's also its words, and its
first and last time in its slot), ``bloom`` (one partition of the fingerprints' Bloom filter a row)
and ``common`` (words too frequent to tell titles apart, fixed when the history is made). Each batch
adds one run to the first two, and a manifest names the runs that count, so that a history can be
opened again by another process and a batch that failed half way leaves no trace. Runs are merged
when there are many of one size.

Fingerprints: one for a record's id, one for the page its address leads to, and those of its title,
which are winnowed: the title's distinct words are put in one order for all titles, rare ones first,
and of every window of as many words as a partner must share the first is kept, joined with the
time's slot. A batch meets history only where the Bloom filter lets a fingerprint through, and reads
only the buckets of the store that those lie in; history is not read again as text.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as A
from .lineage import cut, delete, drop, new_path

SHARE = 0.7
SLOT_S = 2 * 3600
#: A word is common if at least one title in so many has it; so there are at most so many times a title's words of them.
COMMON = 2000
#: Fingerprints that a bucket is laid out for; with GROWN times as many, the next merge of all runs takes more buckets.
BUCKET_KEYS, GROWN = 65_536, 4
#: Bits for each fingerprint of a Bloom filter, and hash functions.
BLOOM_BITS, BLOOM_HASHES = 12, 7
#: Runs of one size that are merged into one.
MERGE = 8
#: Fingerprints that a look-up may broadcast; more of them meet the store in a shuffled join.
MOST_ASKED = 1_000_000
#: Rows that may match another of their batch and are decided in one task; more of them are decided in rounds.
ONE_TASK = 200_000
#: Parameters of an address that say where a reader came from, not which page it is.
TRACKING = r"(?i)^(utm_\w*|\w*clid|gclsrc|dclid|mc_\w+|mkt_\w+|trk\w*|ref|ref_\w+|referrer|via|cmp|cmpid|campaign\w*|ncid|ito|xtor|spm|igsh\w*|_ga|_gl|_hs\w*|hsa_\w+|pk_\w+|piwik_\w+|at_\w+|ns_\w+|s_cid|soc_\w+|share\w*|src|source|from|feature|fb_\w+|yclid|msclkid|wt_\w+)$"


def page_of(url: Column) -> Column:
    """The page an address leads to: without scheme, case of the host, www or m before it, port, closing slash, fragment and tracking."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    place = F.regexp_extract(bare, r"^([^?]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(place, r"^([^/]*)", 1)), r"^(?:(?:www\d?|m|mobile|amp)\.)+|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, r"^[^/]*(.*)$", 1), r"/+$", "")
    query = F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda x: (x != "") & ~F.regexp_extract(x, r"^([^=]*)", 1).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


RECORDS = "ref long, k_id long, k_url long, at long, slot long, words array<long>"
STORE = "key long, cls long, words array<long>, lo long, hi long"


def _records(df: DataFrame, ref: str, common: np.ndarray | None = None) -> DataFrame:
    """(ref, k_id, k_url, at, slot, words, cls): at in microseconds, words as distinct hashes in order; null or wordless titles have no cls.

    With ``common``, ``kept`` has the winnowed words.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "title"):
                n = part.num_rows
                cp, off, _ = A.canonical(*A.explode(part.column("title")))
                w = A.Words(A.blank_tags(cp, off), off)
                row, h = A.distinct(w.row, w.hash)
                at = part.column("at")
                slot = pa.array(at.fill_null(0).to_numpy() // (SLOT_S * 1_000_000), mask=at.is_null().to_numpy(zero_copy_only=False))
                out = {c: part.column(c) for c in ("ref", "k_id", "k_url", "at")} | {"slot": slot, "words": A.lists(row, h.astype(np.int64), n)}
                if common is not None:
                    row, h = winnow(h, row, common)
                    out["kept"] = A.lists(row, h.astype(np.int64), n)
                yield pa.record_batch(list(out.values()), names=list(out))

    at = F.col("published_at")
    if not isinstance(df.schema["published_at"].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError("published_at must be a timestamp")
    at = F.unix_micros(at.cast("timestamp"))
    keyed = df.select(
        F.col(ref).cast("long").alias("ref") if ref != "id" else F.xxhash64(F.lit("ref"), "id").alias("ref"),
        F.when(F.col("id").isNotNull(), F.xxhash64(F.lit("id"), "id")).alias("k_id"),
        F.when(F.length("source_url") > 0, F.xxhash64(F.lit("url"), page_of(F.col("source_url")))).alias("k_url"),
        at.alias("at"),
        "title",
    )
    out = A.over(keyed, rows, RECORDS + (", kept array<long>" if common is not None else ""))
    return out.withColumn("cls", F.when(F.col("at").isNotNull() & (F.size("words") > 0), F.xxhash64(F.lit("cls"), "words", "slot")))


def _winnowed(records: DataFrame, common: np.ndarray) -> DataFrame:
    """Records that were made before the common words were known, with ``kept``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("words")
            size = words.value_lengths().to_numpy()
            row, h = winnow(words.flatten().to_numpy().astype(np.uint64), np.repeat(np.arange(len(size)), size), common)
            yield b.append_column("kept", A.lists(row, h.astype(np.int64), b.num_rows))

    return A.over(records, rows, RECORDS + ", cls long, kept array<long>")


def _titles(records: DataFrame) -> DataFrame:
    """(cls, slot, words, kept, lo, hi): the different titles of a slot, with their first and last time in it.

    Titles of one slot are always near enough, those of the slot before or after are if its last or
    first time is; so two times stand for all, and a title repeated without end is one row.
    """
    one = [F.any_value(c).alias(c) for c in ("slot", "words", "kept")]
    return records.where("cls IS NOT NULL").groupBy("cls").agg(*one, F.min("at").alias("lo"), F.max("at").alias("hi"))


def _title_keys(titles: DataFrame, ask: bool, *columns: str) -> DataFrame:
    """(key, *columns) of the titles: for their slot, or, to ask with, also for the slots beside it."""
    near = F.explode(F.array(*[F.col("slot") + d for d in (-1, 0, 1)])) if ask else F.col("slot")
    return titles.select("kept", *columns, near.alias("_slot")).select("_slot", *columns, F.explode("kept").alias("_w")).select(F.xxhash64("_w", "_slot").alias("key"), *columns)


def winnow(words: np.ndarray, row: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the winnowed words of each row's set; ``row`` is in order.

    A partner shares at least a part SHARE of a set's words. So the words are put in one order for
    all rows, and of every window of that many of them the first is kept: two such partners keep one
    word in common at least, wherever it stands in the title.
    """
    place = np.searchsorted(common, words)
    frequent = (common[np.minimum(place, len(common) - 1)] == words) if len(common) else np.zeros(len(words), bool)
    order = np.lexsort((words, frequent, row))  # rare words first, then by hash
    words, row = words[order], row[order]
    starts = np.searchsorted(row, row)
    size = np.searchsorted(row, row, "right") - starts
    window = np.ceil(SHARE * size - 1e-9).astype(np.int64)
    keep = np.arange(len(words)) - starts + window <= size  # the first of a window that still fits
    return row[keep], words[keep]


def _exact_keys(records: DataFrame) -> DataFrame:
    return records.select(F.explode(F.array("k_id", "k_url")).alias("key")).where("key IS NOT NULL").distinct()


def _bit_places(keys: np.ndarray, bits: int) -> np.ndarray:
    x = A.mix(keys.astype(np.uint64))
    y = A.mix(x) | np.uint64(1)
    return np.stack([((x + np.uint64(i) * y) % np.uint64(bits)).astype(np.int64) for i in range(BLOOM_HASHES)])


class History:
    """What has been accepted so far, as fingerprints in a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str, common: np.ndarray, manifest: dict, version: int):
        self.spark, self.path, self.common = spark, path.rstrip("/"), common
        self.partitions: int = manifest["partitions"]
        self.runs: list[dict] = manifest["runs"]
        self.version = version

    @classmethod
    def create(cls, articles: DataFrame, path: str | None = None) -> History:
        """A history of the given articles (id, source_url, title, published_at; further columns are ignored)."""
        spark = articles.sparkSession
        path = path or new_path(spark, "history")
        records = cut(_records(articles, "id"), "records")
        n = records.count()
        counts = records.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        counts.where(F.col("n") >= max(2, n / COMMON)).select("word").coalesce(1).write.parquet(f"{path}/common")
        out = cls(spark, path, cls._common(spark, path), {"partitions": _buckets(7 * n), "runs": []}, 0)
        out.add(_winnowed(records, out.common))
        drop(records)
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """The history that lies in a folder, as the last whole batch left it."""
        fs, at = _files(spark, path)
        found = [re.fullmatch(r"manifest-(\d+)\.json", f.getPath().getName()) for f in fs.listStatus(at)]
        versions = [int(m[1]) for m in found if m]
        if not versions:
            raise ValueError(f"no history in {path}")
        manifest = json.loads(spark.read.text(f"{path}/manifest-{max(versions)}.json", wholetext=True).first()[0])
        return cls(spark, path, cls._common(spark, path), manifest, max(versions))

    @staticmethod
    def _common(spark: SparkSession, path: str) -> np.ndarray:
        held = spark.read.schema("word long").parquet(f"{path}/common").toArrow()["word"]  # bounded, see COMMON
        return np.sort(held.to_numpy().astype(np.uint64))

    def _read(self, name: str, schema: str, runs: list[dict] | None = None) -> DataFrame:
        runs = self.runs if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], schema + ", run int, bucket int")
        return self.spark.read.schema(schema + ", run int, bucket int").option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/run={r['run']}" for r in runs])

    def keys(self, runs: list[dict] | None = None) -> DataFrame:
        """(key, cls, words, lo, hi, run, bucket): fingerprints; those of titles with the title they are of."""
        return self._read("keys", STORE, runs)

    def bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.partitions)).cast("int")

    def _commit(self, runs: list[dict]) -> None:
        """Makes these the runs that count: the manifest is written aside and takes its name at once."""
        self.version, self.runs = self.version + 1, runs
        fs, at = _files(self.spark, f"{self.path}/manifest-{self.version}.json")
        aside = at.suffix(".new")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps({"partitions": self.partitions, "runs": runs}), "utf-8"))
        out.close()
        if not fs.rename(aside, at):
            raise RuntimeError(f"{at} is there already: two processes add to one history")

    def add(self, records: DataFrame) -> None:
        """Accepts the records: a new run of fingerprints and of Bloom filters."""
        null = [F.lit(None).cast(t).alias(c) for c, t in (("cls", "long"), ("words", "array<long>"), ("lo", "long"), ("hi", "long"))]
        run = self._write(_exact_keys(records).select("key", *null).unionByName(_title_keys(_titles(records), False, "cls", "words", "lo", "hi")))
        self._commit([*self.runs, run])
        self._merge()

    def _write(self, keys: DataFrame) -> dict:
        number = max((r["run"] for r in self.runs), default=0) + 1
        for name in ("keys", "bloom"):  # what a batch that failed has left
            delete(self.spark, f"{self.path}/{name}/run={number}")

        def filters(table: pa.Table) -> pa.Table:
            n = table.num_rows
            bits = np.zeros(-(-BLOOM_BITS * n // 8) * 8, np.uint8)
            bits[_bit_places(table.column("key").to_numpy(), BLOOM_BITS * n).reshape(-1)] = 1
            return pa.table({"bucket": table.column("bucket").slice(0, 1), "n": pa.array([n], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        keys = keys.withColumn("bucket", self.bucket("key"))
        keys.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/keys/run={number}")
        size = Observation()
        blooms = self.keys([{"run": number}]).select("bucket", "key").distinct().groupBy("bucket").applyInArrow(filters, "bucket int, n long, bits binary")
        blooms.observe(size, F.sum("n").alias("n")).write.parquet(f"{self.path}/bloom/run={number}")
        n = size.get["n"] or 0
        return {"run": number, "keys": n, "level": int(math.log(max(n, 1) / BUCKET_KEYS + 1, MERGE))}

    def _merge(self) -> None:
        """Merges the runs of a size of which there are MERGE; so there are few runs, and a fingerprint is written again a few times at most."""
        for level in sorted({r["level"] for r in self.runs}):
            same = [r for r in self.runs if r["level"] == level]
            if len(same) >= MERGE:
                self.merge(same)

    def merge(self, runs: list[dict] | None = None) -> None:
        """Makes one run of several, or of all, which then get as many buckets as they need."""
        runs = runs or self.runs
        kept = [r for r in self.runs if r not in runs]
        if not kept and sum(r["keys"] for r in runs) > GROWN * BUCKET_KEYS * self.partitions:
            self.partitions = _buckets(sum(r["keys"] for r in runs))
        one = self._write(self.keys(runs).groupBy("key", "cls").agg(F.any_value("words").alias("words"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        self._commit([*kept, one])
        for r in runs:
            for name in ("keys", "bloom"):
                delete(self.spark, f"{self.path}/{name}/run={r['run']}")

    def screen_keys(self, asked: DataFrame) -> DataFrame:
        """The rows of (key, cls) whose key the Bloom filter of its bucket lets through, with the bucket."""

        def rows(ask: pa.Table, bloom: pa.Table) -> pa.Table:
            keys = ask.column("key").to_numpy()
            hit = np.zeros(len(keys), bool)
            if len(keys):
                for n, x in zip(bloom.column("n").to_pylist(), bloom.column("bits").to_pylist(), strict=True):
                    hit |= np.unpackbits(np.frombuffer(x, np.uint8))[_bit_places(keys, BLOOM_BITS * n)].all(0)
            return ask.select(["key", "cls", "bucket"]).filter(pa.array(hit))

        if not self.runs:
            return asked.withColumn("bucket", F.lit(0)).where("false")
        bloom = self.spark.read.schema("bucket int, n long, bits binary").parquet(*[f"{self.path}/bloom/run={r['run']}" for r in self.runs])
        return asked.withColumn("bucket", self.bucket("key")).groupBy("bucket").cogroup(bloom.groupBy("bucket")).applyInArrow(rows, "key long, cls long, bucket int")

    def known(self, records: DataFrame) -> DataFrame:
        """(ref) of the records that history has already."""
        null = F.lit(None).cast("long")
        exact = F.array(*[F.struct(F.col(k).alias("key"), null.alias("cls")) for k in ("k_id", "k_url")])
        slots = F.when(F.col("cls").isNotNull(), F.array(*[F.col("slot") + d for d in (-1, 0, 1)]))
        titled = F.flatten(F.transform(slots, lambda t: F.transform("kept", lambda w: F.struct(F.xxhash64(w, t).alias("key"), F.col("cls").alias("cls")))))
        asked = records.select(F.inline(F.concat(exact, F.coalesce(titled, F.array().cast("array<struct<key: bigint, cls: bigint>>"))))).where("key IS NOT NULL").distinct()
        through = cut(self.screen_keys(asked), "through")
        asking = through.select("bucket", "key", F.col("cls").alias("asked"))
        asking = F.broadcast(asking) if through.count() <= MOST_ASKED else asking
        met = self.keys().select("bucket", "key", "cls", F.col("words").alias("wb"), "lo", "hi").join(asking, ["bucket", "key"]).where(F.col("asked").isNull() == F.col("cls").isNull())
        met = met.select(F.coalesce("asked", "key").alias("tag"), "wb", "lo", "hi")
        mine = records.select("ref", "at", F.inline(F.array(*[F.struct(F.col(k).alias("tag"), F.when(F.lit(k == "cls"), F.col("words")).alias("wa")) for k in ("k_id", "k_url", "cls")])))
        near = (F.abs(F.col("at") - F.col("lo")) <= SLOT_S * 1_000_000) | (F.abs(F.col("at") - F.col("hi")) <= SLOT_S * 1_000_000)
        out = cut(mine.join(met, "tag").where((F.col("wa").isNull() & F.col("wb").isNull()) | (near & shares_enough())).select("ref").distinct(), "known")
        drop(through)
        return out

    def screen(self, batch: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
        """(row_id, accepted) of a batch, which then is part of history as far as it was accepted.

        ``batch`` has row_id (unique, in order of arrival), id, source_url, title and published_at.
        Nulls match nothing; a row of nulls alone is accepted; an empty batch gives an empty result.
        """
        records = cut(_records(batch, "row_id", self.common), "batch")
        known, groups = self.known(records), _groups(records)
        lost = _lost(groups, known, one_task)
        rejected = known.unionByName(lost).withColumn("accepted", F.lit(False))
        result = cut(records.join(rejected, "ref", "left").withColumn("accepted", F.coalesce("accepted", F.lit(True))), "screened")
        self.add(result.where("accepted"))
        drop(records, known, groups)
        return result.select(F.col("ref").alias("row_id"), "accepted")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the cluster's storage layer has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _buckets(keys: int) -> int:
    return max(1, -(-keys // BUCKET_KEYS))


def shares_enough() -> Column:
    both = F.size(F.array_intersect("wa", "wb"))
    return both * 10 >= (F.size("wa") + F.size("wb") - both) * round(SHARE * 10)


def _groups(records: DataFrame) -> DataFrame:
    """(ref, at, g, own): the groups that rows belong to or look at, as far as they hold several rows.

    Groups are the rows of an id, of a page, of a title in a slot of time, whose rows all match each
    other; so a crowd of equal rows never makes pairs, and one row of a group is accepted at most.
    Alike titles link their groups: their rows look at each other's, and match if their times are near.
    """
    own = records.select("ref", "at", F.explode(F.array("k_id", "k_url", "cls")).alias("g")).where("g IS NOT NULL").withColumn("own", F.lit(True))
    titles = _titles(records)
    pairs = _title_keys(titles, True, "cls", "words").toDF("key", "c", "wa").join(_title_keys(titles, False, "cls", "words").toDF("key", "d", "wb"), "key")
    links = pairs.where(F.col("c") != F.col("d")).where(shares_enough()).select(F.col("c").alias("cls"), F.col("d").alias("g")).distinct()
    looks = records.select("ref", "at", "cls").join(links, "cls").select("ref", "at", "g").withColumn("own", F.lit(False))
    table = own.unionByName(looks)
    shared = table.groupBy("g").agg(F.min("ref").alias("x"), F.max("ref").alias("y")).where("x < y").select("g")
    return cut(table.join(shared, "g", "left_semi").select("ref", "at", "g", "own"), "groups")


def _lost(groups: DataFrame, known: DataFrame, one_task: int) -> DataFrame:
    """(ref) of the rows that history does not know, and that an accepted row before them matches."""
    table = groups.join(known, "ref", "left_anti").select("ref", "at", "g", "own")
    return _decide(table) if groups.count() <= one_task else _rounds(table)


def _decide(table: DataFrame) -> DataFrame:
    """The decision row after row, in one task; the table was counted and is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), schema=pa.schema([("ref", pa.int64()), ("at", pa.int64()), ("g", pa.int64()), ("own", pa.bool_())])).sort_by("ref")
        taken: dict[int, int | None] = {}
        lost: list[int] = []
        mine: list[int] = []
        ref, at, g, own = (t.column(c).to_pylist() for c in ("ref", "at", "g", "own"))
        hit = False
        for i in range(len(ref)):
            if g[i] in taken and (own[i] or abs(taken[g[i]] - at[i]) <= SLOT_S * 1_000_000):
                hit = True
            if own[i]:
                mine.append(g[i])
            if i + 1 == len(ref) or ref[i + 1] != ref[i]:
                if hit:
                    lost.append(ref[i])
                else:
                    taken.update((x, at[i]) for x in mine)
                hit, mine = False, []
        yield pa.record_batch([pa.array(lost, pa.int64())], names=["ref"])

    return A.over(table.coalesce(1), run, "ref long")


def _rounds(table: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """The decision in rounds: rows that an accepted row matches are lost, and of the others each is accepted that no undecided row comes before in any group it looks at."""
    open_, lost, taken = cut(table, "open"), [], None
    for _ in range(max_rounds):
        if taken is not None:
            near = F.col("own") | (F.abs(F.col("at") - F.col("its")) <= SLOT_S * 1_000_000)
            met = open_.join(taken.toDF("g", "its", "by"), "g").where((F.col("by") < F.col("ref")) & near)
            lost.append(cut(met.select("ref").distinct(), "lost"))
            open_ = open_.join(lost[-1], "ref", "left_anti")
        first = open_.where("own").groupBy("g").agg(F.min("ref").alias("first"))
        ready = open_.join(first, "g", "left").groupBy("ref").agg(F.bool_and(F.coalesce(F.col("first") >= F.col("ref"), F.lit(True))).alias("ready"))
        state = cut(open_.join(ready, "ref"), "state")
        won = state.where("ready AND own").select("g", "at", "ref")
        taken = won if taken is None else taken.unionByName(won)
        open_ = state.where("NOT ready").drop("ready")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"rows are still undecided after {max_rounds} rounds")
    out = table.select("ref").limit(0)
    for x in lost:
        out = out.unionByName(x)
    return out.distinct()


def screen_batches(articles: DataFrame, batches: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(batch_no, row_id, accepted) of all batches, taken one after another against a history that starts with the articles."""
    history = History.create(articles)
    numbers = [r[0] for r in batches.select("batch_no").distinct().orderBy(F.col("batch_no").asc_nulls_first()).collect()]
    out = None
    for n in numbers:
        part = history.screen(batches.where(F.col("batch_no").eqNullSafe(F.lit(n))), one_task).select(F.lit(n).cast("int").alias("batch_no"), "row_id", "accepted")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else articles.sparkSession.createDataFrame([], "batch_no int, row_id long, accepted boolean")
