"""Problem 2: visually identical text with different characters.

The work is done by ``arrowtext.canonical`` on whole Arrow batches: table gathers, expansion offsets
and pairwise composition over numpy code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as A


def to_one_form(df: DataFrame, columns: list[str], changed: str = "changed_fields") -> DataFrame:
    """The rows with the named string columns in one form, and ``changed``: the names of those that had to change.

    Nulls stay null and empty texts empty; neither counts as changed. All other columns pass
    through; a column already named ``changed`` is refused.
    """
    if changed in df.columns:
        raise ValueError(f"there is a column {changed} already")
    schema = T.StructType([*df.schema.fields, T.StructField(changed, T.ArrayType(T.StringType()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, *columns):
                out = {n: part.column(n) for n in part.schema.names}
                which = np.zeros((part.num_rows, len(columns)), bool)
                for j, c in enumerate(columns):
                    col = part.column(c)
                    null = col.is_null().to_numpy(zero_copy_only=False)
                    cp, off, ch = A.canonical(*A.explode(col))
                    out[c] = A.implode(cp, off, null)
                    which[:, j] = ch
                r, k = np.nonzero(which)
                names = pa.DictionaryArray.from_arrays(pa.array(k, pa.int32()), pa.array(columns)).dictionary_decode()
                off = np.searchsorted(r, np.arange(part.num_rows + 1)).astype(np.int32)
                out[changed] = pa.ListArray.from_arrays(pa.array(off), names)
                yield pa.record_batch(list(out.values()), names=list(out))

    return A.over(df, rows, schema)


def changed_fields(articles: DataFrame, residue: DataFrame) -> DataFrame:
    """(article_id, field) of the titles and summaries whose characters had to change, but for summaries that are residue."""
    found = to_one_form(articles.select(F.col("id").alias("article_id"), "title", "summary"), ["title", "summary"]).where(F.size("changed_fields") > 0)
    found = found.select("article_id", F.explode("changed_fields").alias("field")).distinct()
    out = residue.where("table_name = 'articles'").select(F.col("row_key").alias("article_id"), F.lit("summary").alias("field"))
    return found.join(out, ["article_id", "field"], "left_anti")
