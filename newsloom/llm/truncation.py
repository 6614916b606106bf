"""Problem 5: text cut off by field limits.

Per source and column the lengths of values without a proper end are counted in characters and in
bytes; a length far above its neighbours is the source's limit, and values of that length without
terminal punctuation are cut. The rest of a source's lengths tell how it ends its texts elsewhere: if
it usually does with punctuation, a running text without it was cut mid-transfer, where no spike can
show; a source that does without is believed at its limits only, or where a text breaks off in the
middle of a character, an entity or a tag. Headlines cut mid-transfer are told by words after which
headlines do not end, or by a last word that begins a longer word of the same article's text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrowtext as A
from .lineage import cut

#: A word is kept as itself in headline contexts if at least one headline in so many has it; other words count as names.
COMMON = 2000
#: A headline is cut if fewer than ENDS of the other headlines with its last context end there; fewer than
#: ENDS_WHOLE if its last word stands in the summary too (never, if that is a name), and fewer than
#: ENDS_BEGUN if its last word is no common one and only begins a word of the summary.
ENDS, ENDS_WHOLE, ENDS_BEGUN = 0.04, 0.004, 0.3
#: A context seen less often says nothing; then the next shorter one speaks.
SEEN = 12
#: Words of the longest context.
ORDER = 4
#: A length is a limit if so many values of a source have it, and so many times more than have the lengths around it
#: and than have the two lengths above it.
SPIKE, TIMES, AROUND = 6, 4.0, 12
#: A source does without punctuation at the end if less than this share of its texts off its limits has some (of SEEN texts at least).
HABIT = 0.5

# What can follow a text. Characters that end a sentence, also in quotes or brackets.
ENDED = r"[.!?।॥．！？。|][”\"’')\]»]*$"
#: What readers are shown in place of the rest.
MORE = r"(?i)(?:\s*(?:…|\.\.\.+|\[\s*(?:…|\.{2,})\s*\]|\(\s*(?:…|\.{2,})\s*\)|\[\s*continue reading\s*\]|continue reading|read more|read on|\(more\)|\[more\]|थप पढ्नुहोस्|पूरा पढ्नुहोस्|[»›>→]+))+$"
#: Notes that may follow a whole text.
NOTES = r"(?:\s+(?:\[\p{L}[^\[\]]*\]|\(\p{L}[^()]*\)|[—–]\s+\p{Lu}[^.!?।…]{0,40}|\p{Lu}[\p{L} ]{2,30}:\s[^.!?।…]{1,60}|©[^.!?।…]{0,60}))+$"
#: What may be tacked on to a headline.
TAGS = r"(?:\s+(?:\([^()]{2,20}\)|\[\p{L}[^\[\]]{2,20}\]|\|\s*\S.{1,20}|[–—-]\s+\p{L}\S{1,12}))+$"
#: A character, an entity or a tag of which only the beginning is there.
BROKEN = r"(?:�|&#?\w{0,7}|<[a-zA-Z/][^<>]{0,60}|<)$"
#: Fixed value: what stands between the words of a text.
BETWEEN = "\t\n\r\u00a0\u2007\u2009\u202f\u3000.,;:!?।|()[]{}\"“”‘’«»…–—"
#: Characters of a running text's end that are looked at.
TAIL = 400
UNSEEN = r"[\s ​-‏⁠-⁤﻿­]+$"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, UNSEEN, "")


def _running(text: Column) -> Column:
    """Whether a running text lacks a proper end; only the last characters without markup and padding tell."""
    plain = F.regexp_replace(F.regexp_replace(text, r"</[a-zA-Z]+>", " "), "<[a-zA-Z][^<>]*>", " ")
    plain = F.when(F.contains(text, F.lit("<")), plain).otherwise(text)
    tail = _bare(F.right(plain, F.lit(TAIL)))
    t = F.when((F.length(tail) < TAIL) & (F.length(plain) > TAIL), F.right(_bare(plain), F.lit(TAIL))).otherwise(tail)
    noted = F.regexp_extract(t, "^(?s)(.*?)" + NOTES, 1)  # a note counts only after a whole sentence or after a cut
    rest = F.when(noted != "", noted).otherwise(t)
    more = _bare(F.regexp_replace(rest, MORE, ""))
    more = F.when(more != "", more).otherwise(rest)
    return F.when(t.rlike(ENDED) & ~t.rlike(MORE) & ~t.rlike(r"[\])]$"), False).otherwise(~more.rlike(ENDED) | more.rlike(BROKEN))


def _headline_words(part: pa.RecordBatch, column: str) -> A.Words:
    cp, off, _ = A.canonical(*A.explode(part.column(column)))
    return A.Words(A.blank_tags(cp, off), off)


def _common_words(titles: DataFrame) -> np.ndarray:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "t"):
                w = _headline_words(part, "t")
                _, h = A.distinct(w.row, w.hash)
                u, n = np.unique(h, return_counts=True)
                yield pa.record_batch([pa.array(u.astype(np.int64)), pa.array(n)], names=["w", "n"])

    n = titles.count()
    kept = A.over(titles.select("t"), rows, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, n / COMMON))
    return np.sort(np.array(kept.select("w").toArrow()["w"].to_pylist(), np.int64).astype(np.uint64))


def _contexts(w: A.Words, common: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The contexts of each word of the headlines, of ORDER words up to it and of fewer, whether it is the last, and whether it is a name."""
    h = w.hash.copy()
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h[common[at] != h] = 7
    else:
        h[:] = 7
    digits = (A.table("kind")[w.low[w.start]] & 16) > 0 if len(h) else np.empty(0, bool)
    h[digits] = 11
    out = [A.mix(h)]
    for d in range(1, ORDER):
        back = np.zeros(len(h), np.uint64)
        same = np.zeros(len(h), bool)
        same[d:] = w.row[d:] == w.row[:-d]
        back[same] = h[np.flatnonzero(same) - d]
        out.append(A.mix(out[-1] * np.uint64(0x100000001B3) + back))
    last = np.ones(len(h), bool)
    last[:-1] = w.row[1:] != w.row[:-1]
    return out[::-1], last, h == 7


def _context_counts(titles: DataFrame, common: np.ndarray) -> DataFrame:
    """(ctx, n, ends): how often a context occurs in headlines, and how often they end there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "t"):
                ctx, last, _ = _contexts(_headline_words(part, "t"), common)
                u, inv = np.unique(np.concatenate(ctx), return_inverse=True)
                n = np.bincount(inv, minlength=len(u))
                ends = np.bincount(inv, weights=np.tile(last, ORDER), minlength=len(u)).astype(np.int64)
                yield pa.record_batch([pa.array(u.astype(np.int64)), pa.array(n), pa.array(ends)], names=["ctx", "n", "ends"])

    return A.over(titles.select("t"), rows, "ctx long, n long, ends long").groupBy("ctx").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def _one_form(titles: DataFrame) -> DataFrame:
    """The headlines with ``t`` and ``summary`` in one form and without markup; only those that may differ from it are brought to it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "t", "summary"):
                out = {n: part.column(n) for n in part.schema.names}
                for c in ("t", "summary"):
                    odd = ~A.plain(*A.explode(part.column(c)))
                    if odd.any():
                        cp, off, _ = A.canonical(*A.explode(part.column(c).filter(pa.array(odd))))
                        out[c] = pa.compute.replace_with_mask(part.column(c), pa.array(odd), A.implode(A.blank_tags(cp, off), off))
                yield pa.record_batch(list(out.values()), names=list(out))

    named = titles.select("id", "source_id", "title", "t", F.coalesce("summary", F.lit("")).alias("summary"))
    return A.over(named, rows, "id string, source_id string, title string, t string, summary string")


def _last_words(titles: DataFrame, common: np.ndarray) -> DataFrame:
    """(id, source_id, title, ctx, begins, whole, name): the last contexts, longest first, and whether the last word begins a word of the summary, is one, is a name."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "t"):
                w = _headline_words(part, "t")
                ctx, last, name = _contexts(w, common)
                at = np.flatnonzero(last)
                own = w.row[at]
                n = part.num_rows
                mine = np.zeros((n, ORDER), np.uint64)
                for j, c in enumerate(ctx):
                    mine[own, j] = c[at]
                named = np.zeros(n, bool)
                named[own] = name[at]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * ORDER), pa.array(mine.astype(np.int64).reshape(-1)))
                yield pa.record_batch([*(part.column(c) for c in ("id", "source_id", "title", "begins", "whole")), lists, pa.array(named)], names=["id", "source_id", "title", "begins", "whole", "ctx", "name"])

    word = F.regexp_replace(F.substring_index(F.regexp_replace(F.lower(_bare(F.col("t"))), r"[\s\p{Z}]+", " "), " ", -1), r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")
    word = F.trim(F.translate(word, BETWEEN, " " * len(BETWEEN)))  # split as the summary is
    text = F.concat(F.lit(" "), F.translate(F.lower(F.col("summary")), BETWEEN, " " * len(BETWEEN)), F.lit(" "))
    whole = F.contains(text, F.concat(F.lit(" "), word, F.lit(" ")))
    begins = F.contains(text, F.concat(F.lit(" "), word))
    asked = _one_form(titles).select("id", "source_id", "title", "t", ((word != "") & begins & ~whole).alias("begins"), ((word != "") & whole).alias("whole"))
    return A.over(asked, rows, "id string, source_id string, title string, begins boolean, whole boolean, ctx array<long>, name boolean")


def limits(values: DataFrame) -> DataFrame:
    """(source_id, field, unit, size, n): lengths at which a source's unended values pile up; ``values`` has source_id, field, chars, bytes and open."""
    each = values.where("open").select("source_id", "field", F.explode(F.expr("map('chars', chars, 'bytes', bytes)")).alias("unit", "size"))
    hist = each.groupBy("source_id", "field", "unit", "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source_id", "field", "unit").orderBy("size").rangeBetween(-AROUND, AROUND)
    near = Window.partitionBy("source_id", "field", "unit").orderBy("size").rangeBetween(-2, 2)
    base = (F.sum("n").over(w) - F.sum("n").over(near)) / (2 * AROUND - 4)
    up = Window.partitionBy("source_id", "field", "unit").orderBy("size").rangeBetween(1, 2)
    above = F.coalesce(F.sum("n").over(up), F.lit(0)) / 2
    piled = (F.col("n") >= SPIKE) & (F.col("n") >= TIMES * (F.col("base") + 1)) & (F.col("n") >= TIMES * (F.col("above") + 1))
    return hist.withColumn("base", base).withColumn("above", above).where(piled).drop("base", "above")


def field_values(articles: DataFrame) -> DataFrame:
    """(article_id, source_id, field, chars, bytes, open, sure) of the values there are; open: without a proper end; sure: cut by its look, wherever its source's limits are (null if only its source's habit tells).

    Null and empty values have no row. A summary that is the article's headline is taken as one.
    """
    a = articles.select("id", "source_id", "title", "summary", "summary_translated")
    texts = a.select("id", "source_id", "title", F.explode(F.expr("map('summary', summary, 'summary_translated', summary_translated)")).alias("field", "value")).where(F.length(F.trim("value")) > 0)
    headline = F.lower(F.trim("value")) == F.lower(F.trim(F.coalesce("title", F.lit(""))))
    open_ = _running(F.col("value")) & ~headline
    broken = F.when(open_, F.when(_bare(F.col("value")).rlike(BROKEN) | _bare(F.col("value")).rlike(MORE), True))  # asked of open values only
    running = texts.select(F.col("id").alias("article_id"), "source_id", "field", F.length(F.col("value")).alias("chars"), F.octet_length("value").alias("bytes"), open_.alias("open"), broken.alias("sure"))

    titles = a.where(F.length(F.trim("title")) > 0).withColumn("t", F.regexp_replace(_bare(F.col("title")), TAGS, ""))
    titles = titles.withColumn("t", F.when(F.col("t") == "", F.col("title")).otherwise(F.col("t")))
    titles = titles.withColumn("marked", F.col("t").rlike(MORE) | F.col("t").rlike(BROKEN))
    plain = titles.where("NOT marked")
    common = _common_words(plain)
    counts = cut(_context_counts(plain, common).where(F.col("n") >= SEEN).select("ctx", F.col("n"), F.col("ends")), "contexts")
    ends = cut(_last_words(plain, common), "ends")
    asked = ends.select("id", F.posexplode("ctx").alias("pos", "ctx")).join(counts, "ctx")
    rate = F.greatest(F.col("ends") - 1, F.lit(0)) / (F.col("n") - 1)  # without the headline itself
    rate = asked.withColumn("rate", rate).groupBy("id").agg(F.min_by("rate", "pos").alias("rate"), F.max_by("rate", "pos").alias("alone"), F.min("pos").alias("pos"))
    ends = ends.join(rate, "id", "left")
    bar = F.when(F.col("begins") & F.col("name"), ENDS_BEGUN).when(F.col("whole"), F.when(F.col("name"), 0.0).otherwise(ENDS_WHOLE)).otherwise(ENDS)
    known = F.coalesce("rate", F.lit(0.0))
    unheard = ~F.col("whole") & (F.coalesce("pos", F.lit(ORDER)) >= ORDER - 1) & (known < 0.5)  # neither the word nor what it follows is known
    closing = ~F.col("name") & (F.coalesce("alone", F.lit(0.0)) >= ENDS_BEGUN / 2)  # a word that headlines often end with
    sure = unheard | ((known < bar) & ~closing)
    told = ends.select(F.col("id").alias("article_id"), "source_id", F.lit("title").alias("field"), F.length(F.col("title")).alias("chars"), F.octet_length("title").alias("bytes"), (~_bare(F.col("title")).rlike(ENDED)).alias("open"), sure.alias("sure"))
    marked = titles.where("marked").select(F.col("id").alias("article_id"), "source_id", F.lit("title").alias("field"), F.length(F.col("title")).alias("chars"), F.octet_length("title").alias("bytes"), F.lit(True).alias("open"), F.lit(True).alias("sure"))
    return running.unionByName(told).unionByName(marked)


def cut_values(articles: DataFrame) -> DataFrame:
    """The rows of field_values with ``cut``, ``at_limit`` (at a spike of its source's lengths) and ``by_end`` (cut by how it ends, off the spikes).

    A value without a proper end is cut if it is at its source's limit; elsewhere if its look tells so,
    unless the source's values off the limits usually have no proper end.
    """
    values = cut(field_values(articles), "values")
    found = limits(values)
    out = values
    for unit in ("chars", "bytes"):
        own = found.where(F.col("unit") == unit).select(F.col("source_id").alias("s"), F.col("field").alias("f"), F.col("size").alias("z"), F.lit(True).alias(f"at_{unit}"))
        out = out.join(own, F.col("source_id").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")) & (F.col(unit) == F.col("z")), "left").drop("s", "f", "z")
    out = out.withColumn("at_limit", F.coalesce("at_chars", "at_bytes", F.lit(False)))
    off = out.where("NOT at_limit").groupBy("source_id", "field").agg((F.count_if(~F.col("open")) / F.count("*")).alias("ended"), F.count("*").alias("n"))
    careless = off.where((F.col("n") >= SEEN) & (F.col("ended") < HABIT)).select(F.col("source_id").alias("s"), F.col("field").alias("f"), F.lit(False).alias("ends"))
    out = out.join(careless, F.col("source_id").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")), "left")
    told = F.coalesce("sure", "ends", F.lit(True))
    return out.select("article_id", "source_id", "field", "chars", "bytes", (F.col("open") & (F.col("at_limit") | told)).alias("cut"), "at_limit", (F.col("open") & told & ~F.col("at_limit")).alias("by_end"))


def without_residue(cut_fields: DataFrame, residue: DataFrame) -> DataFrame:
    bad = residue.where("table_name = 'articles'").select(F.col("row_key").alias("article_id"), F.lit("summary").alias("field"))
    return cut_fields.join(bad, ["article_id", "field"], "left_anti")


def rates(cut_fields: DataFrame) -> DataFrame:
    """(source_id, field, n, n_cut, n_limit, n_end, share): how often each source cuts each field, at its limit and by how the rest end."""
    n_cut = F.count_if("cut")
    return cut_fields.groupBy("source_id", "field").agg(F.count("*").alias("n"), n_cut.alias("n_cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("n_limit"), F.count_if("by_end").alias("n_end"), F.round(n_cut / F.count("*"), 6).alias("share"))
