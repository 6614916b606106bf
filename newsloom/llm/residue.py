"""Problem 1: template residue, filler, error pages and script notices.

Texts are brought to one form and cut into segments. A segment is *trusted residue* if it is made
of phrases known from templates and servers; a text is residue at once if it holds an unfilled
template field. All segments get a 64-bit SimHash of their shingles. Candidates for near-duplicates
of labelled segments share a key of the partitioned SimHash tables (every pair of five blocks of the
hash is a table's key, so any two hashes at most three bits apart share a key) or one of their first
shingles in the order of their hashes: as many as any segment of the similarity must share one of,
so no pair is missed. Hamming distance and shared shingles verify them, and the label spreads along
verified pairs until no component that holds a trusted segment grows further.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .lineage import cut

#: Names that template fields go by.
FIELD_NAMES = "title headline heading summary excerpt teaser lead intro body content caption section author byline date date_line dateline description standfirst name text शीर्षक सारांश विवरण लेखक मिति पाठ तस्बिर"
#: Notations of an unfilled template field.
FIELDS = [
    r"\{\{", r"\{%.{0,80}?%\}", r"<%.{0,80}?%>", r"\{\d{1,2}\}", r"\{[^\W\d][\w.ऀ-ॿ]{2,40}\}",
    r"%[A-Z][A-Z_.]{2,40}%", r"%[a-z]+(?:_[a-z]+)*%", r"%\{[\w.ऀ-ॿ ]{1,40}\}", r"%\([\wऀ-ॿ]{1,40}\)s", r"@@[\w.ऀ-ॿ]{2,40}@@", r"(?<!\w)__[\w.ऀ-ॿ]{2,40}?__(?!\w)",
    r"\$\{[\w.ऀ-ॿ ]{1,40}\}?", r"\$[A-Zऀ-ॿ][A-Z_.ऀ-ॿ]{2,40}\$", r"#\{[\w.ऀ-ॿ ]{1,40}\}?", r"\*\|[^|*।]{1,40}[|।]\*", r"\[\[[^\[\]]{1,40}\]\]", r"\[[A-Z][A-Z_.]{2,40}\]",
    r"«(?:[a-z]+[_.][a-z_.]+|(?i:" + "|".join(FIELD_NAMES.split()) + r"))»", r"\[(?i:insert|enter|add|paste)\s[^\[\]]{1,60}\]", r"<[^<>]{1,40}\s(?i:goes) here>", r"\bTK TK\b",
]
#: Phrases of placeholders and filler, servers' error pages, and notices that want scripts or cookies.
PHRASES = """
placeholder copy
placeholder text
test post please ignore
dummy text
dummy standfirst
sample text for layout only
this is sample text
sample description for the preview card
body copy goes here
copy goes here
text goes here
replace this paragraph before publishing
enter a short description of the article
insert text here
your text here
lorem ipsum
page not found
access denied
you don't have permission to view
you do not have permission
the requested url was not found on this server
sorry the page you are looking for does not exist
the page you are looking for does not exist
the page you requested could not be found
return to the home page or try a search
that's all we know
something went wrong on our end
please try again later
error establishing a database connection
upstream connect error or disconnect/reset before headers
fatal error
your session has expired
this content is not available in your region
this site is down for maintenance
we are down for maintenance
content-type text/html
please enable javascript
enable javascript
enable scripts
enable javascript to continue
please enable javascript to continue
please enable scripts to continue
please enable javascript and cookies to continue
you need to enable javascript
you need to enable scripts
you need to enable javascript and cookies to run this app
this site works best with
this site works best with javascript enabled
this site works best with scripts enabled
this site works best with javascript and cookies enabled
it looks like javascript is disabled
it looks like scripts is disabled
it looks like javascript and cookies is disabled
allow javascript for
allow javascript and cookies for
allow scripts for
we use javascript to check that you are a person
we use javascript and cookies to check that you are a person
we use scripts to check that you are a person
turn it on in your browser settings and reload the page
your browser has javascript switched off
your browser has scripts switched off
your browser has javascript and cookies switched off
if nothing appears your browser may be blocking scripts
your browser may be blocking scripts
disable your ad blocker and reload to view this story
disable your ad blocker
checking your browser before you reach
verify you are human
शीर्षक यहाँ
विवरण यहाँ
तस्बिर यहाँ
विवरण यहाँ राख्नुहोस्
यहाँ समाचारको सारांश लेख्नुहोस्
नमुना पाठ
नमुना पाठ मात्र हो
यो अनुच्छेद पछि हटाइनेछ
सर्भरमा समस्या आयो
कृपया केही समयपछि पुनः प्रयास गर्नुहोस्
कृपया कुकी र स्क्रिप्ट अनुमति दिनुहोस्
कृपया जाभास्क्रिप्ट अनुमति दिनुहोस्
त्यसपछि पृष्ठ पुनः लोड गर्नुहोस्
तपाईंको ब्राउजरले स्क्रिप्ट चलाउन सक्दैन
यो पृष्ठ हेर्न ब्राउजरमा जाभास्क्रिप्ट सक्रिय गर्नुहोस्
यो पृष्ठ हेर्न ब्राउजरमा स्क्रिप्ट सक्रिय गर्नुहोस्
यो पृष्ठ हेर्न ब्राउजरमा कुकी सक्रिय गर्नुहोस्
प्राविधिक त्रुटिका कारण समाचार देखाउन सकिएन
यो सामग्री हेर्न तपाईंलाई अनुमति छैन
पृष्ठ उपलब्ध छैन
पृष्ठ भेटिएन
गृहपृष्ठमा फर्कनुहोस्
माफ गर्नुहोस् तपाईंले खोज्नुभएको पृष्ठ भेटिएन
तपाईंले खोज्नुभएको पृष्ठ भेटिएन
""".strip().split("\n")
#: Phrases that occur beside those, and elsewhere too; they only count for how much of a segment is covered.
PARTS = """
two lines max
do not publish
the desk will replace it later
max 160 characters
please try again in
on line
request id
reference
ray
please sign in again
to run this app
it looks like
is disabled
and refresh
we use cookies
to check that you are a person
enable it and try again
so parts of this page cannot be shown
loading
if nothing appears
this usually takes
this usually takes seconds
just a moment
home news contact
test test
text text
this is a test
uncaught exception in
http/1.1
something went wrong
oops
new draft
text to follow
माफ गर्नुहोस्
प्रकाशन नगर्नुहोस्
परीक्षण सामग्री
त्यसैले सामग्री देखिएन
""".strip().split("\n")
#: HTTP status codes and their reasons.
STATUS = """
400 bad request
401 unauthorized
403 forbidden
404 not found
408 request timeout
410 gone
429 too many requests
500 internal server error
502 bad gateway
503 service unavailable
503 service temporarily unavailable
504 gateway timeout
504 gateway time-out
४०४ पृष्ठ उपलब्ध छैन
""".strip().split("\n")
for _line in STATUS:
    _code, _reason = _line.split(" ", 1)
    PHRASES += [_line, _reason, f"error {_code}", f"error {_line}"]
#: Words of Latin filler and of keyboard filler.
FILLER = "lorem ipsum dolor amet consectetur consectetuer adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit curabitur asdf qwer qwerty foo blah xxxx xxx foobar hjkl test".split()
#: Share of a segment's words that known phrases have to cover for it to be trusted residue.
COVERED = 0.6
#: A phrase of so many words outside quotes is trusted wherever it stands, one word fewer at the head of a segment.
STRONG_WORDS = 4
#: Hashes farther apart are no candidates. Of 200,000 pairs just at SIMILARITY the farthest were 25 bits apart (99.9 % within 19), unrelated hashes are 32.
HAMMING = 32
SIMILARITY = 0.8
SHINGLE = 5
#: Blocks of the SimHash; every two of them are the key of one table.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
TABLES = list(combinations(range(len(BLOCKS)), 2))
#: The tables are made for hashes this near; a pair that only shares a key of theirs and is farther apart met by chance.
TABLES_FIND = 3
#: Keys out of shingles have this bit, which keys of the tables have not.
PREFIX = 1 << 62
#: Bits of the bitmap that tells which keys any labelled segment has: 128 kB whatever the data.
BITMAP = 1 << 20
#: So many candidate pairs are broadcast at most; more are shuffled.
MOST_PAIRS = 1_000_000


def _words(text: str) -> np.ndarray:
    cp, off = A.explode(pa.array([text]))
    return A.Words(cp, off).hash


@cache
def _phrases(sure: bool) -> dict[int, np.ndarray]:
    """The phrases' hashes by their number of words: those that make a segment residue, or those that only cover it."""
    by: dict[int, set[int]] = {1: {int(_words(w)[0]) for w in FILLER}} if sure else {}
    for p in PHRASES if sure else PARTS:
        h = _words(p)
        if len(h):
            g = A.shingle(h, np.zeros(len(h), np.int64), len(h)) if len(h) > 1 else (h, None)
            by.setdefault(len(h), set()).add(int(g[0][0]))
    return {n: np.array(sorted(x), np.uint64) for n, x in by.items()}


@cache
def _fields() -> re.Pattern:
    return re.compile("|".join(FIELDS))


def _is_in(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x if len(sorted_) else np.zeros(len(x), bool)


def _has_field(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a template field, and which code points are in one; only rows with a character of such a notation are looked at one by one."""
    signal = np.isin(cp, np.frombuffer("{}[]<%@_$#*«K".encode("utf-32-le"), np.uint32))
    rows = np.unique(A.row_of(off, np.flatnonzero(signal)))
    out = np.zeros(len(off) - 1, bool)
    inside = np.zeros(len(cp), bool)
    pattern = _fields()
    for r in rows:
        for m in pattern.finditer(cp[off[r] : off[r + 1]].tobytes().decode("utf-32-le")):
            out[r] = True
            inside[off[r] + m.start() : off[r] + m.end()] = True
    return out, inside


def _segments(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The number of the segment that each code point is in: segments end with a sentence, a bar, a line or a tag."""
    kind = A.table("kind")[cp]
    n = len(cp)
    cut_ = (cp == 0x7C) | (cp == 0x0A) | (cp == 0xA9) | (cp == 0x3C) | (cp == 0x3E)
    ends = (kind & 32) > 0
    after = np.ones(n, bool)
    after[:-1] = (kind[1:] & 1) > 0
    cut_ |= ends & after
    begin = np.zeros(n + 1, bool)
    begin[1:] = cut_
    begin[off[:-1]] = True
    return np.cumsum(begin[:n])


@cache
def _lanes() -> np.ndarray:
    """For each byte its eight bits as eight bytes."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(-1)


def simhash(h: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit SimHash of each of n segments out of its words' hashes; ``seg`` is in order."""
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    first = np.r_[True, seg[1:] != seg[:-1]]
    starts = np.flatnonzero(first)
    place = np.arange(len(seg)) - np.repeat(starts, np.diff(np.r_[starts, len(seg)]))
    blocks = np.flatnonzero(first | (place % 255 == 0))  # a lane counts to 255
    raw = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    lanes = np.stack([np.add.reduceat(_lanes()[raw[:, b]], blocks) for b in range(8)], axis=1)
    votes = lanes.view(np.uint8).reshape(len(blocks), 64)
    if len(blocks) > len(starts):
        votes = np.add.reduceat(votes.astype(np.int64), np.searchsorted(blocks, starts), axis=0)
    size = np.diff(np.r_[starts, len(h)])
    out[seg[starts]] = np.packbits(votes.astype(np.int32) * 2 > size[:, None], axis=1).reshape(-1).view(np.uint64)
    return out


def table_keys(sim: np.ndarray) -> np.ndarray:
    """The keys of each hash in all tables, one column a table."""
    part = [(sim >> np.uint64(a)) & np.uint64((1 << w) - 1) for a, w in BLOCKS]
    return np.stack([(part[i] << np.uint64(13) | part[j]) * np.uint64(16) + np.uint64(k) for k, (i, j) in enumerate(TABLES)], axis=1).astype(np.int64)


def prefix_keys(shingles: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of the first shingles of each set: two sets of at least SIMILARITY share one of them, as the shingles of each are in one order."""
    size = shingles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.where(size > 0, size - np.ceil(SIMILARITY * size - 1e-9).astype(np.int64) + 1, 0)
    row = np.repeat(np.arange(len(size)), first)
    at = np.arange(len(row)) - np.repeat(np.cumsum(first) - first, first) + np.repeat(np.cumsum(size) - size, first)
    return row, shingles.flatten().to_numpy()[at] & np.int64(PREFIX - 1) | np.int64(PREFIX)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of all candidate keys of the segments of a batch."""
    tables = table_keys(batch.column("sim").to_numpy().astype(np.uint64))
    row, key = prefix_keys(batch.column("shingles"))
    return np.r_[np.repeat(np.arange(len(tables)), tables.shape[1]), row], np.r_[tables.reshape(-1), key]


def scan(texts: pa.Array) -> dict[str, np.ndarray]:
    """Per segment of the texts: row, hash, SimHash, shingles, and whether it is trusted residue; per row: whether it has a field."""
    cp, off, _ = A.canonical(*A.explode(texts))
    field, in_field = _has_field(cp, off)
    seg_of = _segments(cp, off)
    w = A.Words(A.blank_tags(cp, off), off)
    seg = seg_of[w.start] - 1 if len(w) else np.empty(0, np.int64)
    n = int(seg_of[-1]) if len(seg_of) else 0
    # words with digits or dots inside (numbers, hosts, ids) count as one word
    digit = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(((A.table("kind")[cp] & 16) > 0) | (cp == 0x2E), out=digit[1:])
    slot = digit[w.end] > digit[w.start]
    h = np.where(slot, np.uint64(0x5107), w.hash)
    covered = np.zeros(len(w) + 1, np.int64)
    strong = np.zeros(n, bool)
    quote = np.isin(cp[np.maximum(w.start - 1, 0)], [0x201C, 0x22, 0xAB, 0x2018]) & (w.start > 0) if len(w) else np.empty(0, bool)
    for k, known, sure in [(k, known, sure) for sure in (True, False) for k, known in _phrases(sure).items()]:
        if len(w) < k:
            continue
        if k == 1:
            g, at = w.hash, np.arange(len(w))
        else:
            g, _ = A.shingle(w.hash, np.zeros(len(w), np.int64), k)
            at = np.arange(len(g))
        hit = at[_is_in(g, known)]
        hit = hit[(seg[hit] == seg[hit + k - 1]) & ~quote[hit]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + k, -1)
        if not sure:
            continue
        head = np.r_[True, seg[1:] != seg[:-1]][hit] if len(hit) else np.empty(0, bool)
        if k == 1:  # so many words of filler in a row
            alone = np.zeros(len(w), np.int64)
            alone[hit] = 1
            runs = np.convolve(alone, np.ones(STRONG_WORDS, np.int64), "valid") if len(w) >= STRONG_WORDS else np.empty(0, np.int64)
            first = np.flatnonzero(runs == STRONG_WORDS)
            strong[seg[first[seg[first] == seg[first + STRONG_WORDS - 1]]]] = True
        elif k >= STRONG_WORDS - 1:
            strong[seg[hit[head | (k >= STRONG_WORDS)]]] = True
    inside = np.cumsum(covered)[:-1] > 0
    free = ~slot
    of = np.bincount(seg[free], minlength=n)
    on = np.bincount(seg[free & inside], minlength=n)
    trusted = strong | ((on > 0) & (on >= COVERED * of))
    row = np.zeros(n, np.int64)
    row[seg] = w.row
    words = np.bincount(seg, minlength=n)
    if in_field.any():  # a segment that is a field, and not so short that it is one of its names alone
        trusted |= (words >= SHINGLE) & (np.bincount(seg[in_field[w.start]], minlength=n) >= COVERED * words)
    k = SHINGLE
    g, gs = A.shingle(h, seg, k)
    short = np.flatnonzero(words < k)  # a segment shorter than a shingle is one shingle
    pos = np.searchsorted(seg, short)
    whole = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        more = words[short] > j
        whole[more] = whole[more] * np.uint64(0x100000001B3) + h[pos[more] + j]
    gs, g = A.distinct(np.r_[gs, short], np.r_[g, A.mix(whole)])
    return {"row": row, "sim": simhash(g, gs, n), "trusted": trusted, "words": words, "shingle": g, "shingle_seg": gs, "field": field}


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in A.slices(batch, "text"):
            s = scan(part.column("text"))
            keep = s["words"] > 0
            ids = np.flatnonzero(keep)
            sh = A.lists(s["shingle_seg"], s["shingle"].astype(np.int64), len(keep)).take(pa.array(ids))
            row = pa.array(s["row"][ids])
            yield pa.record_batch(
                [part.column("table_name").take(row), part.column("row_key").take(row), pa.array(s["sim"][ids].astype(np.int64)), sh, pa.array(s["trusted"][ids]), pa.array(s["field"][s["row"][ids]])],
                names=["table_name", "row_key", "sim", "shingles", "trusted", "field"],
            )
            alone = np.flatnonzero(s["field"] & (np.bincount(s["row"][ids], minlength=len(s["field"])) == 0))
            if len(alone):  # a field without a word beside it
                row = pa.array(alone)
                yield pa.record_batch(
                    [part.column("table_name").take(row), part.column("row_key").take(row), pa.array(np.zeros(len(alone), np.int64)), pa.array([[]] * len(alone), pa.list_(pa.int64())), pa.array(np.zeros(len(alone), bool)), pa.array(np.ones(len(alone), bool))],
                    names=["table_name", "row_key", "sim", "shingles", "trusted", "field"],
                )


SEGMENTS = "table_name string, row_key string, sim long, shingles array<long>, trusted boolean, field boolean"


def _bitmap(labelled: DataFrame) -> bytes:
    """Which table keys the labelled segments have, as bits; at most BITMAP numbers reach the driver."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, k = _keys(b)
            yield pa.record_batch([pa.array(np.unique(k % BITMAP))], names=["bit"])

    bits = np.zeros(BITMAP, bool)
    for b in A.over(labelled.select("sim", "shingles"), keys, "bit long").distinct().toArrow().to_batches():
        bits[b.column("bit").to_numpy()] = True
    return np.packbits(bits).tobytes()


def _keyed(df: DataFrame, bitmap: bytes | None) -> DataFrame:
    """One row for each candidate key of a segment; with a bitmap only for keys that a labelled segment may have."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool) if bitmap else None
        for b in batches:
            r, k = _keys(b)
            if bits is not None:
                may = bits[k % BITMAP]
                r, k = r[may], k[may]
            take = pa.array(r)
            yield pa.record_batch([pa.array(k), b.column("code").take(take), b.column("sim").take(take)], names=["key", "code", "sim"])

    return A.over(df.select("code", "sim", "shingles"), rows, "key long, code long, sim long").distinct()


def residue_rows(texts: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(table_name, row_key) of the texts that are residue or hold some.

    ``texts`` has table_name, row_key and text. Null and empty texts are never residue; a row_key
    given twice is reported once; further columns are ignored. The label spreads until a round
    labels nothing new; ``max_rounds`` only guards against a loop without end and raises if reached.
    """
    segments = cut(A.over(texts.select("table_name", "row_key", "text").where(F.length("text") > 0), _segment_rows, SEGMENTS), "segments")
    code = F.xxhash64("shingles").alias("code")  # stands for the shingles until pairs are known
    new = segments.where("trusted").select(code, "sim", "shingles").distinct()
    open_ = segments.where("NOT trusted AND NOT field").select(code, "sim", "shingles")
    spread: list[DataFrame] = []
    for _ in range(max_rounds):
        met = _keyed(open_, _bitmap(new)).join(_keyed(new, None).toDF("key", "of", "of_sim"), "key")
        apart = F.bit_count(F.col("sim").bitwiseXOR(F.col("of_sim")))
        met = met.where((apart <= TABLES_FIND) | ((F.col("key") >= PREFIX) & (apart <= HAMMING)))
        pairs = cut(met.select("code", "of").distinct(), "pairs")
        if pairs.limit(MOST_PAIRS + 1).count() <= MOST_PAIRS:
            pairs = F.broadcast(pairs)
        pairs = open_.join(pairs, "code").distinct().alias("a").join(new.alias("b"), F.col("a.of") == F.col("b.code"))
        both = F.size(F.array_intersect("a.shingles", "b.shingles"))
        alike = both >= SIMILARITY * (F.size("a.shingles") + F.size("b.shingles") - both)
        found = pairs.where(alike).select("a.code", "a.sim", "a.shingles").distinct()
        for before in spread:
            found = found.join(before, ["sim", "shingles"], "left_anti")
        new = cut(found, "labelled")
        if new.isEmpty():
            break
        spread.append(new)
    else:
        raise RuntimeError(f"labels still spread after {max_rounds} rounds")
    out = segments.where("trusted OR field").select("table_name", "row_key")
    for found in spread:
        out = out.unionByName(segments.where("NOT trusted AND NOT field").join(found, ["sim", "shingles"], "left_semi").select("table_name", "row_key"))
    return out.distinct()


def feed_texts(raw_stories: DataFrame | None, articles: DataFrame | None) -> DataFrame:
    """The standfirsts of feed records and archived articles in one table, as residue_rows takes them."""
    parts = []
    if raw_stories is not None:
        parts.append(raw_stories.select(F.lit("raw_stories").alias("table_name"), F.col("raw_id").cast("string").alias("row_key"), F.col("description").alias("text")))
    if articles is not None:
        parts.append(articles.select(F.lit("articles").alias("table_name"), F.col("id").alias("row_key"), F.col("summary").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
