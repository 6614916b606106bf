"""Whole-batch text work on numpy code-point arrays.

A text column of an Arrow batch becomes two arrays: ``cp`` (the code points of all rows, one after
another) and ``off`` (where each row begins, one entry more than there are rows). Every function
works on these arrays at once; no row is turned into a Python string.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import ship

#: Bytes of text handled at a time, so that temporary arrays stay small whatever the batch size.
CHUNK_BYTES = 1 << 20

_N = sys.maxunicode + 1
_U = np.uint64

# --------------------------------------------------------------------------- Arrow <-> code points


def explode(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of a string column; nulls count as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):  # older Arrow keeps the wrapper
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    _, obuf, dbuf = col.buffers()
    boff = np.frombuffer(obuf, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(dbuf, np.uint8)[boff[0] : boff[-1]] if dbuf is not None and boff[-1] > boff[0] else np.empty(0, np.uint8)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return cp, lead[boff - boff[0]]


def implode(cp: np.ndarray, off: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The string column of code points; rows marked in ``null`` become nulls."""
    data = np.ascontiguousarray(cp, np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    size = np.ones(len(cp), np.int64)
    size += cp >= 0x80
    size += cp >= 0x800
    size += cp >= 0x10000
    ends = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    out = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(ends[off]), pa.py_buffer(data)).cast(pa.string())
    if null is not None and null.any():
        import pyarrow.compute as pc

        out = pc.if_else(pa.array(null), pa.scalar(None, pa.string()), out)
    return out


def slices(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about CHUNK_BYTES of text each; a longer text is a piece by itself."""
    if batch.num_rows == 0:
        return
    import pyarrow.compute as pc

    size = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        size += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // CHUNK_BYTES
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def over(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the workers' path."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def row_of(off: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The row that holds each position."""
    return np.searchsorted(off, pos, "right") - 1


def concat(parts: list[tuple[np.ndarray, np.ndarray]], glue: int = 0x20) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, the texts of several columns with a glue character between them."""
    n = len(parts[0][1]) - 1
    sizes = [np.diff(o) for _, o in parts]
    total = sum(sizes) + (len(parts) - 1)
    off = np.zeros(n + 1, np.int64)
    np.cumsum(total, out=off[1:])
    out = np.full(off[-1], glue, np.uint32)
    at = off[:-1].copy()
    for (cp, o), size in zip(parts, sizes, strict=True):
        out[np.repeat(at - o[:-1], size) + np.arange(len(cp))] = cp
        at += size + 1
    return out, off


# --------------------------------------------------------------------------- tables

#: Letters that cannot be told from a Latin letter, as pairs "look-alike, Latin": Cyrillic, Greek,
#: Armenian, phonetic and Coptic ones, Cherokee and Lisu.
LOOK_ALIKES = (
    "аa еe оo рp сc уy хx ѕs іi јj ԁd һh ԛq ԝw ѵv ӏl кk АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ "
    "οo νv αa ιi ρp κk υu γy χx ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϲc ϳj ɑa ɡg ıi ꞌ' օo սu հh "
    "ԍG ԌG ѴV ԚQ ԜW ƽs Ɩl ɩi ǀl ɪi ᴄc ᴏo ᴠv ᴡw ᴢz ꜱs ⲟo ⲞO ⲣp ⲢP ⲥc ⲤC "
    "ᎠD ᎡR ᎢT Ꭵi ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG Ꮒh ᏃZ ᏞL ᏟC ᏢP ᏙV ᏚS ᏦK ᏴB ᏔW ᏒR ᏕS "
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
).split()
#: Devanagari spellings in two characters that look like one (Unicode Standard, chapter 12,
#: vowel letters not to be used), as "first, second, one letter".
DEVANAGARI_PAIRS = ["अॆऄ", "अाआ", "र्इईX", "उुऊ", "एॅऍ", "एॆऎ", "एेऐ", "अॉऑ", "आॅऑ", "अॊऒ", "आॆऒ", "अोओ", "आेओ", "अौऔ", "आैऔ", "ओेऔ", "अॅॲ", "ाेो", "ाैौ", "ाॅॉ", "ाॆॊ", "ेाो", "ैाौ"]
VIRAMAS = [0x94D, 0x9CD, 0xA4D, 0xACD, 0xB4D, 0xBCD, 0xC4D, 0xCCD, 0xD4D]


@functools.cache
def _tables() -> dict:
    """Tables made from the Unicode character database: what each code point becomes."""
    to = np.arange(_N, dtype=np.uint32)
    size = np.ones(_N, np.uint8)
    lower = np.arange(_N, dtype=np.uint32)
    kind = np.zeros(_N, np.uint8)  # bits: 1 white space, 2 punctuation or symbol, 4 letter or digit, 8 mark, 16 digit, 32 sentence end
    script = np.zeros(_N, np.uint8)  # 1 Latin, 2 Cyrillic, Greek or Armenian, 3 other letters
    exp: dict[int, list[int]] = {}
    ccc = np.zeros(_N, np.uint8)
    pairs: dict[int, int] = {}
    for o in (*range(0x30000), *range(0xE0000, 0xE01F0)):  # and the unseen ones far above
        c = chr(o)
        cat = unicodedata.category(c)
        if cat in ("Cn", "Co", "Cs"):
            continue
        low = c.lower()
        if len(low) == 1:
            lower[o] = ord(low)
        ccc[o] = unicodedata.combining(c)
        if c.isspace():
            kind[o] = 1
        elif cat[0] in "PS":
            kind[o] = 2
        elif cat[0] in "LN":
            kind[o] = 4 | (16 if cat == "Nd" else 0)
        elif cat[0] == "M":
            kind[o] = 8
        if cat[0] == "L":
            if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0xFF21 <= o <= 0xFF5A or 0xFB00 <= o <= 0xFB06:
                script[o] = 1
            elif 0x370 <= o < 0x590 or 0x1F00 <= o < 0x2000 or 0x2DE0 <= o < 0x2E00 or 0xA640 <= o < 0xA6A0:
                script[o] = 2
            else:
                script[o] = 3
        d = unicodedata.decomposition(c)
        tag = d.split(">")[0][1:] if d.startswith("<") else ""
        if cat == "Zs":
            to[o] = 0x20
        elif cat == "Cf" or (cat == "Cc" and o not in (9, 10, 13)) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            size[o] = 0  # cannot be seen
        elif tag in ("wide", "narrow", "font") or (tag in ("compat", "initial", "medial", "final", "isolated") and all(unicodedata.category(x)[0] == "L" for x in unicodedata.normalize("NFKC", c))):
            exp[o] = [ord(x) for x in unicodedata.normalize("NFKC", c)]
        elif d and not tag and unicodedata.normalize("NFC", c) != c:
            exp[o] = [ord(x) for x in unicodedata.normalize("NFC", c)]
        elif d and not tag and len(d.split()) == 2 and not 0xAC00 <= o < 0xD7A4:
            a, b = (int(x, 16) for x in d.split())
            pairs[a << 21 | b] = o
    for t in DEVANAGARI_PAIRS:
        if len(t) == 3:
            pairs[ord(t[0]) << 21 | ord(t[1])] = ord(t[2])
    keys = np.array(sorted(pairs), np.int64)
    flat, start = [], np.zeros(_N, np.int32)
    for o, xs in exp.items():
        if len(xs) == 1:
            to[o] = xs[0]
        else:
            size[o], start[o] = len(xs), len(flat)
            flat += xs
    like = np.zeros(_N, np.uint32)
    for p in LOOK_ALIKES:
        like[ord(p[0])] = ord(p[1])
    for c in ".!?।॥…":
        kind[ord(c)] |= 32
    special = (to != np.arange(_N)) | (size != 1)
    second = np.zeros(_N, bool)
    second[keys & 0x1FFFFF] = True
    virama = np.zeros(_N, bool)
    virama[VIRAMAS] = True
    return {"to": to, "size": size, "flat": np.array(flat, np.uint32), "start": start, "special": special, "keys": keys, "one": np.array([pairs[int(k)] for k in keys], np.uint32), "second": second, "lower": lower, "kind": kind, "script": script, "like": like, "virama": virama, "ccc": ccc}


def table(name: str) -> np.ndarray:
    return _tables()[name]


# --------------------------------------------------------------------------- one form for all texts


def canonical(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text in one form, and whether that changed it.

    Full-width, half-width and font variants and ligatures become ordinary letters, spaces of any
    kind a space, unseen characters vanish (but for a joiner after a virama), combining marks join
    their letters, two-part Devanagari vowels become one letter, a bar used as a danda becomes
    one, and look-alike letters inside a word of another script become that script's.
    """
    t = _tables()
    rows = len(off) - 1
    changed = np.zeros(rows, bool)
    hit = np.flatnonzero(t["special"][cp])
    if len(hit):
        c = cp[hit]
        joiner = (c == 0x200D) | (c == 0x200C)
        if joiner.any():
            before = np.maximum(hit - 1, 0)
            fine = joiner & (hit > off[row_of(off, hit)]) & t["virama"][cp[before]]
            hit = hit[~fine]
    if len(hit):
        changed[row_of(off, hit)] = True
        size = np.ones(len(cp), np.int64)
        size[hit] = t["size"][cp[hit]]
        ends = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        one = cp.copy()
        one[hit] = t["to"][cp[hit]]
        out = np.repeat(one, size)
        for k in range(2, int(size.max()) + 1):  # the longer the expansion, the fewer
            at = hit[size[hit] == k]
            src = t["start"][cp[at]]
            for j in range(k):
                out[ends[at] + j] = t["flat"][src + j]
        cp, off = out, ends[off]
    cp, off = _compose(cp, off, changed, t)
    cp = _danda(cp, off, changed)
    one_script = _scripts(cp, off, changed, t)
    if one_script is not cp:  # a letter of another script may now join the mark after it
        cp, off = _compose(one_script, off, changed, t)
    return cp, off, changed


def plain(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts ``canonical`` and ``blank_tags`` leave as they are for sure: a few look-ups instead of the whole work."""
    t = _tables()
    at = np.flatnonzero(t["special"][cp] | (t["like"][cp] > 0) | (cp == 0x7C) | (cp == 0x3C))
    joins = at[(cp[at] == 0x200D) | (cp[at] == 0x200C)]
    fine = joins[(joins > off[row_of(off, joins)]) & t["virama"][cp[np.maximum(joins - 1, 0)]]]
    second = np.flatnonzero(t["second"][cp])
    second = second[second > 0]
    key = cp[second - 1].astype(np.int64) << 21 | cp[second].astype(np.int64)
    joined = second[t["keys"][np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)] == key]
    out = np.ones(len(off) - 1, bool)
    out[row_of(off, np.r_[np.setdiff1d(at, fine, assume_unique=True), joined])] = False
    return out


def _compose(cp: np.ndarray, off: np.ndarray, changed: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Joins each mark with the letter before it, innermost first, until nothing joins."""
    for _ in range(8):
        at = np.flatnonzero(t["second"][cp])
        if not len(at):
            break
        row = row_of(off, at)
        at, row = (x[at > off[row]] for x in (at, row))
        if not len(at):
            break
        key = cp[at - 1].astype(np.int64) << 21 | cp[at].astype(np.int64)
        k = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        ok = t["keys"][k] == key
        at, row, k = at[ok], row[ok], k[ok]
        if not len(at):
            break
        first = np.ones(len(at), bool)
        first[1:] = np.diff(at) > 1  # of a run of joins, the first only; the rest next time
        at, row, k = at[first], row[first], k[first]
        changed[row] = True
        cp = cp.copy()
        cp[at - 1] = t["one"][k]
        keep = np.ones(len(cp), bool)
        keep[at] = False
        gone = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(~keep, out=gone[1:])
        cp, off = cp[keep], off - gone[off]
    return cp, off


def _danda(cp: np.ndarray, off: np.ndarray, changed: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(cp == 0x7C)
    if len(at):
        row = row_of(off, at)
        before, after = cp[np.maximum(at - 1, 0)], cp[np.minimum(at + 1, len(cp) - 1)]
        ok = (at > off[row]) & (before >= 0x900) & (before <= 0x97F)
        ok &= (at + 1 == off[row + 1]) | ((table("kind")[after] & 1) > 0) | np.isin(after, [0x201D, 0x2019, 0x22, 0x27])
        if ok.any():
            cp = cp.copy()
            cp[at[ok]] = 0x964
            changed[row[ok]] = True
    return cp


def _scripts(cp: np.ndarray, off: np.ndarray, changed: np.ndarray, t: dict) -> np.ndarray:
    like = t["like"][cp]
    if not like.any():
        return cp
    kind = t["kind"][cp]
    letter = (kind & 12) > 0
    edge = np.zeros(len(cp), bool)
    edge[off[:-1][off[:-1] < len(cp)]] = True
    start = letter.copy()
    start[1:] &= ~letter[:-1] | edge[1:]
    run = np.cumsum(start) - 1
    n = int(run[-1]) + 1 if len(run) else 0
    s = t["script"][cp]
    ours = np.flatnonzero(letter)
    latin = np.bincount(run[ours], (s[ours] == 1) & (like[ours] == 0), n) > 0
    alien = np.bincount(run[ours], (s[ours] == 2) | (like[ours] > 0), n) > 0
    fix = alien & latin  # a word wholly in another script is that script's own
    at = ours[fix[run[ours]] & (like[ours] > 0)]
    if len(at):
        changed[row_of(off, at)] = True
        cp = cp.copy()
        cp[at] = like[at]
    return cp


# --------------------------------------------------------------------------- words


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inv = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, _U), np.full(n, inv, _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hash(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of code points that depends on nothing else."""
    up, down = _powers(max(21, int(len(cp) + 1).bit_length()))
    acc = np.zeros(len(cp) + 1, _U)
    np.cumsum(mix(cp.astype(_U) + _U(0x51ED27)) * up[: len(cp)], out=acc[1:])
    return mix((acc[end] - acc[start]) * down[start] + (end - start).astype(_U))


def blank_tags(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Markup becomes spaces: from '<' before a letter, '/' or '!' to the next '>' of the same text."""
    lt = np.flatnonzero(cp == 0x3C)
    if not len(lt):
        return cp
    nxt = cp[np.minimum(lt + 1, len(cp) - 1)]
    lower = nxt | 0x20
    lt = lt[((lower >= 0x61) & (lower <= 0x7A)) | (nxt == 0x2F) | (nxt == 0x21)]
    gt = np.flatnonzero(cp == 0x3E)
    if not len(lt) or not len(gt):
        return cp
    k = np.searchsorted(gt, lt)
    ok = k < len(gt)
    lt, k = lt[ok], k[ok]
    end = gt[k]
    ok = row_of(off, lt) == row_of(off, end)
    lt, end = lt[ok], end[ok]
    delta = np.zeros(len(cp) + 1, np.int64)
    np.add.at(delta, lt, 1)
    np.add.at(delta, end + 1, -1)
    out = cp.copy()
    out[np.cumsum(delta)[:-1] > 0] = 0x20
    return out


class Words:
    """The words of all rows: pieces between white space, lower case, without punctuation at their ends."""

    def __init__(self, cp: np.ndarray, off: np.ndarray):
        t = _tables()
        self.rows = len(off) - 1
        low = t["lower"][cp]
        kind = t["kind"][cp]
        space = (kind & 1) > 0
        begin = ~space
        begin[1:] &= space[:-1]
        firsts = off[:-1][off[:-1] < len(cp)]
        begin[firsts] = ~space[firsts]
        token = np.cumsum(begin)
        core = np.flatnonzero((kind & 3) == 0)
        tok = token[core]
        new = np.ones(len(tok), bool)
        new[1:] = tok[1:] != tok[:-1]
        last = np.ones(len(tok), bool)
        last[:-1] = new[1:]
        self.cp, self.low = cp, low
        self.start, self.end = core[new], core[last] + 1
        self.hash = span_hash(low, self.start, self.end) if len(core) else np.empty(0, _U)
        self.row = row_of(off, self.start)
        self.off = np.searchsorted(self.row, np.arange(self.rows + 1))

    def __len__(self) -> int:
        return len(self.start)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash and the row of every run of k consecutive words, with repeats."""
        n = len(self) - k + 1
        if n <= 0:
            return np.empty(0, _U), np.empty(0, np.int64)
        return shingle(self.hash, self.row, k)


def shingle(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    acc = np.zeros(n, _U)
    for j in range(k):
        acc = acc * _U(0x100000001B3) + h[j : j + n]
    inside = row[:n] == row[k - 1 :]
    return mix(acc[inside]), row[:n][inside]


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs, ordered by both."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


def lists(row: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    """A list column out of values ordered by row."""
    off = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))
