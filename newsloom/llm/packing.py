"""Problem 6: filling fixed-capacity containers with documents.

Lengths are counted in tokens of a public tokenizer. Only (document, source, tokens) travels: the
corpus is dealt into partitions of bounded size, each partition fills window after window of
containers. Deficit round-robin over the source queues chooses what a window takes, so that sources
come in their target proportions; best fit places it, and gaps are topped up with the largest item
that fits, on credit of its source. What a source is owed or owes goes on to the next window, and
with what is left over to the next level of partitions, until one partition remains. A partition
leaves over less than a window of documents and a bounded number of containers, the emptiest; so a
task of any level, the last included, has a bounded number of tokens, whatever the lengths are.
"""

from __future__ import annotations

import base64
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import arrowtext as A
from .lineage import cut

#: Fixed value: how the tokenizer's words are told apart.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Containers of a window, documents of a partition, partitions that meet at the next level.
WINDOW, PART, FAN = 64, 50_000, 16
#: Containers that are emptier than this at the end of a partition are taken apart for the next level, but no more than CARRY of them.
FULL, CARRY = 0.995, 2 * WINDOW
#: Sources whose shares a join may broadcast; more are joined with a shuffle.
SMALL = 100_000


def tokenizer_file(path: str | None = None) -> bytes:
    """The tokenizer's ranks: from ``path``, or from the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, "rb") as f:
        return f.read()


def token_counts(documents: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, source, tokens) of the documents with text; ``ranks`` is a file of tiktoken's form."""
    held = documents.sparkSession.sparkContext.broadcast(ranks)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in held.value.splitlines() if x)}
        code = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            for part in A.slices(batch, "text"):
                n = [len(code.encode_ordinary(t)) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), part.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").where(F.length("text") > 0).mapInArrow(rows, "doc_id long, source string, tokens long")


def fill(size: np.ndarray, source: np.ndarray, share: np.ndarray, owed: np.ndarray, capacity: int, window: int, last: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Which container each item goes to (-1: left over), its place there, and the number of containers.

    ``owed`` is what each source is owed in tokens; it is changed in place. Without ``last``, less than
    a window of items is left over, and those of the CARRY emptiest containers below FULL.
    """
    n = len(size)
    box, place = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    queues = [deque() for _ in share]
    stacks: dict[int, list[int]] = defaultdict(list)
    sizes = 0  # bit s: an item of s tokens waits
    length = size.tolist()
    origin = source.tolist()
    for i in range(n):
        queues[origin[i]].append(i)
        stacks[length[i]].append(i)
        sizes |= 1 << length[i]
    active = [s for s, q in enumerate(queues) if q]
    waiting, tokens = n, int(size.sum())
    gone = bytearray(n)
    boxes: list[list[int]] = []
    rooms: list[int] = []

    def take(i: int) -> None:
        nonlocal waiting, tokens, sizes
        gone[i] = 1
        waiting -= 1
        tokens -= length[i]
        own = stacks[length[i]]
        while own and gone[own[-1]]:
            own.pop()
        if not own:
            sizes &= ~(1 << length[i])

    while waiting and (last or tokens >= window * capacity):
        credit = owed + share * window * capacity
        chosen: list[int] = []
        want = window * capacity
        progress = True
        for s in active:
            while queues[s] and gone[queues[s][0]]:
                queues[s].popleft()
        active = [s for s in active if queues[s]]
        while progress and want > 0:  # rounds over the queues; a source takes while it is owed its next item
            progress = False
            for s in active:
                q = queues[s]
                while q and gone[q[0]]:
                    q.popleft()
                if q and want > 0 and length[q[0]] <= credit[s]:
                    i = q.popleft()
                    credit[s] -= length[i]
                    want -= length[i]
                    chosen.append(i)
                    progress = True
        if not chosen:  # all that is owed is smaller than the next items: the source owed most goes first
            s = max(active, key=lambda s: credit[s])
            i = queues[s].popleft()
            credit[s] -= length[i]
            chosen.append(i)
        chosen.sort(key=lambda i: -length[i])
        first = len(boxes)
        by_room: dict[int, list[int]] = defaultdict(list)
        open_rooms = 0
        back: list[int] = []
        for i in chosen:
            fits = open_rooms >> length[i]
            if fits:
                room = length[i] + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    open_rooms &= ~(1 << room)
            elif len(boxes) - first < window:
                b = len(boxes)
                boxes.append([])
                rooms.append(capacity)
                room = capacity
            else:
                back.append(i)
                continue
            boxes[b].append(i)
            rooms[b] = room - length[i]
            take(i)
            if rooms[b]:
                by_room[rooms[b]].append(b)
                open_rooms |= 1 << rooms[b]
        for i in reversed(back):
            queues[origin[i]].appendleft(i)
            credit[origin[i]] += length[i]
        active = sorted({*active, *(origin[i] for i in back)})
        for b in range(first, len(boxes)):
            while rooms[b] and (fits := sizes & ((1 << (rooms[b] + 1)) - 1)):
                own = stacks[fits.bit_length() - 1]
                while gone[own[-1]]:
                    own.pop()
                i = own[-1]
                boxes[b].append(i)
                rooms[b] -= length[i]
                credit[origin[i]] -= length[i]
                take(i)
        owed[:] = credit
    used = 0
    empty = sorted((b for b, room in enumerate(rooms) if room > (1 - FULL) * capacity), key=lambda b: -rooms[b])
    apart = set() if last else set(empty[:CARRY])
    for b, items in enumerate(boxes):
        if b not in apart:
            at = 0
            for i in items:
                box[i], place[i] = used, at
                at += length[i]
            used += 1
        else:
            for i in items:
                owed[origin[i]] += length[i]
    return box, place, used


def _with_share(items: DataFrame, targets: dict[str | None, float] | None) -> DataFrame:
    """The items with ``share``, their source's part of the tokens: as the targets have it, or that of all documents."""
    if targets:
        shares = items.sparkSession.createDataFrame([(s, float(x)) for s, x in targets.items()], "of string, share double")
    else:
        shares = items.groupBy(F.col("source").alias("of")).agg(F.sum("tokens").cast("double").alias("share"))
    shares = F.broadcast(shares) if shares.limit(SMALL + 1).count() <= SMALL else shares
    return items.join(shares, F.col("source").eqNullSafe(F.col("of")), "left").select("doc_id", "source", "tokens", F.coalesce("share", F.lit(0.0)).alias("share"))


def pack(lengths: DataFrame, capacity: int, targets: dict[str | None, float] | None = None, window: int = WINDOW, part: int = PART, fan: int = FAN) -> DataFrame:
    """(doc_id, piece, first_token, tokens, container, place): where each document or piece stands.

    ``lengths`` has doc_id, source and tokens. A document is divided only if it has more tokens than
    the capacity: into full pieces, each a container of its own, and one rest. Documents without
    tokens have no row; doc_ids need not be unique. ``targets`` are the sources' shares of the tokens
    (those without one come in only where room is left); unset, those of all documents. Each source
    has a queue of its own, in the partitions that hold some of it. ``place`` is the first token's
    place in the container.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = lengths.sparkSession
    items = lengths.where("tokens > 0").select("doc_id", "source", F.col("tokens").cast("long").alias("tokens"))
    count = items.count()
    items = _with_share(items, targets)
    cells = items.select("doc_id", "source", F.explode(F.expr(f"transform(sequence(0, cast(ceil(tokens / {capacity}D) as int) - 1), i -> struct(i as piece, i * {capacity}L as first_token, least({capacity}L, tokens - i * {capacity}L) as tokens))")).alias("p"), "share").select("doc_id", "source", "p.*", "share")
    whole = cells.where(F.col("tokens") == capacity)
    whole = whole.withColumn("container", F.concat_ws("-", F.lit("w"), "doc_id", "piece", "first_token")).withColumn("place", F.lit(0).cast("long"))
    left = cells.where(F.col("tokens") < capacity).withColumn("owed", F.lit(0.0))

    parts = max(1, -(-count // part))
    out = [whole.select("doc_id", "piece", "first_token", "tokens", "container", "place")]
    schema = "doc_id long, source string, piece int, first_token long, tokens long, container string, place long, share double, owed double"
    level = 0
    key = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int")
    left = left.withColumn("part", key)
    ship(spark)
    while True:
        last = parts == 1

        def run(key: tuple, table: pa.Table, level: int = level, last: bool = last) -> pa.Table:
            no = key[0].as_py()
            real = pa.compute.is_valid(table.column("tokens"))
            debts = table.filter(pa.compute.invert(real))
            t = table.filter(real).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("tokens", "ascending")])
            order = np.argsort(A.mix(t.column("doc_id").to_numpy().astype(np.uint64) * np.uint64(31) + t.column("piece").to_numpy().astype(np.uint64)), kind="stable")
            t = t.take(pa.array(order))
            sources = t.column("source").combine_chunks().dictionary_encode("encode")
            names, src = sources.dictionary.to_pylist(), sources.indices.to_numpy().astype(np.int64)
            number = {s: i for i, s in enumerate(names)}
            share, owed = np.zeros(len(names)), np.zeros(len(names))
            share[src] = t.column("share").to_numpy()
            share = share / share.sum() if share.sum() > 0 else np.full(len(names), 1 / max(len(names), 1))
            for s, x in zip(debts.column("source").to_pylist(), debts.column("owed").to_pylist(), strict=True):
                if s in number:
                    owed[number[s]] += x
            box, place, _ = fill(t.column("tokens").to_numpy(), src, share, owed, capacity, window, last)
            boxes = pa.array([f"{level}-{no}-{b}" if b >= 0 else None for b in box.tolist()], pa.string())
            rows = pa.table([t.column(c) for c in ("doc_id", "source", "piece", "first_token", "tokens")] + [boxes, pa.array(place), t.column("share"), pa.nulls(len(t), pa.float64())], names=["doc_id", "source", "piece", "first_token", "tokens", "container", "place", "share", "owed"])
            if last:
                return rows
            left = np.unique(src[box < 0])  # what is owed matters as long as something of the source is left
            k = len(left)
            carry = pa.table([pa.nulls(k, pa.int64()), pa.array([names[i] for i in left], pa.string()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.array(owed[left])], names=rows.column_names)
            return pa.concat_tables([rows, carry])

        done = cut(_apply(left, run, schema), f"packed-{level}")
        out.append(done.where("container IS NOT NULL").select("doc_id", "piece", "first_token", "tokens", "container", "place"))
        if last:
            break
        parts = -(-parts // fan)
        level += 1
        left = done.where("container IS NULL").withColumn("part", F.pmod(F.col("part"), F.lit(parts)).cast("int"))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def _apply(left: DataFrame, run, schema: str) -> DataFrame:
    """Runs a partition's filling and keeps its number, by which the next level brings neighbours together."""

    def numbered(key: tuple, table: pa.Table) -> pa.Table:
        rows = run(key, table)
        return rows.append_column("part", pa.array([key[0].as_py()] * len(rows), pa.int32()))

    return left.groupBy("part").applyInArrow(numbered, schema + ", part int")


def room(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, pieces, tokens, room): room is the share of the containers that stays empty."""
    n = F.countDistinct("container")
    return packed.agg(n.alias("containers"), F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.round(1 - F.sum("tokens") / (n * capacity), 6).alias("room"))
