"""Document frequencies, the TF-IDF vocabulary and category encoders."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FEATURES, MIN_DF, MAX_LEVELS = 5000, 2, 100

#: Bytes of tokens that are counted at once, and tokens (of all, before any are counted) for each task that adds counts up.
COMBINE_BYTES, TASK_TOKENS = 16 << 20, 4_000_000


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, c: counts of tokens, given out whenever ``COMBINE_BYTES`` of tokens have come in."""
    held, size = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch.column(0))
            size += batch.nbytes
        if held and (batch is None or size >= COMBINE_BYTES):
            counts = pc.value_counts(pa.chunked_array(held))
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["token", "c"])
            held, size = [], 0


def _document_frequency(docs: DataFrame, tokens: str, min_df: int, held: int) -> DataFrame:
    """``held``: the number of all tokens, for the number of tasks that add up."""
    each = docs.select(F.explode(F.array_distinct(tokens)).alias("token")).where("token <> ''")
    dealt = each.mapInArrow(_combined, "token string, c long").repartition(max(1, -(-held // TASK_TOKENS)), "token")
    return dealt.groupBy("token").agg(F.sum("c").alias("df")).where(F.col("df") >= max(1, min_df))


def _totals(docs: DataFrame, tokens: str) -> tuple[int, int]:
    """Documents and tokens."""
    return tuple(docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(tokens)), F.lit(0))).first())


def document_frequency(docs: DataFrame, tokens: str = "tokens", min_df: int = MIN_DF) -> DataFrame:
    """token, df of tokens in ``min_df`` documents at least (below 1 counts as 1).

    Distinct tokens may grow with the table, so no task holds all of those it reads: partial counts are made of ``COMBINE_BYTES`` of tokens at a time, and
    added up in tasks of about ``TASK_TOKENS`` tokens each.
    """
    return _document_frequency(docs, tokens, min_df, _totals(docs, tokens)[1])


def idf(df: Column, n: int) -> Column:
    return F.log((1.0 + n) / (1.0 + df)) + 1.0


def _first(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows with ``idx`` from 0; the window only sees the ``k`` rows of the top-k."""
    return df.orderBy(*order).limit(k).withColumn("idx", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def fit_vocabulary(docs: DataFrame, tokens: str = "tokens", max_features: int = MAX_FEATURES, min_df: int = MIN_DF) -> DataFrame:
    """idx, token, df, idf of the most frequent tokens, ties by token. All documents count, empty ones too."""
    n, held = _totals(docs, tokens)
    top = _first(_document_frequency(docs, tokens, min_df, held), [F.desc("df"), F.asc("token")], max_features if max_features > 0 else MAX_FEATURES)
    return top.select("idx", "token", "df", idf(F.col("df"), n).alias("idf"))


def fit_category(df: DataFrame, value: Column, field: str, levels: int = MAX_LEVELS) -> DataFrame:
    """field, value, count, idx of the most frequent values that are not empty, ties by value."""
    counts = df.select(value.alias("value")).where("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return _first(counts, [F.desc("count"), F.asc("value")], levels).select(F.lit(field).alias("field"), "value", "count", "idx")
