"""Feature assembly in long form (row, idx, value): TF-IDF, temporal features, one-hot categories."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import category
from tamiz.functions.timefeat import FEATURES, temporal_features
from tamiz.operators.vocab import fit_category, fit_vocabulary

#: Rows whose tokens are counted at once, and rows of repeated ids whose counts one task adds up.
COUNTED_ROWS, MERGED_ROWS = 512, 4096


def known_counts(vocabulary: DataFrame) -> Callable[[Column], Column]:
    """Of arrays of tokens: idx (ascending), idf, and count ``c`` of those that the vocabulary knows. Missing arrays have none."""
    known = sorted(vocabulary.select("idx", "token", "idf").collect())
    idx, idf, words = np.array([r["idx"] for r in known], np.int64), np.array([r["idf"] for r in known], np.float64), pa.array([r["token"] for r in known], pa.string())

    def part(arrays: pa.Array) -> pa.Array:
        at = pc.fill_null(pc.index_in(flat := arrays.flatten(), value_set=words.cast(flat.type), skip_nulls=True), -1).to_numpy()
        owner = pc.list_parent_indices(arrays).to_numpy()
        found, c = np.unique(owner[at >= 0] * max(1, len(words)) + at[at >= 0], return_counts=True)
        place, owner = found % max(1, len(words)), found // max(1, len(words))
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(arrays)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(idx[place]), pa.array(idf[place]), pa.array(c.astype(np.int64))], ["idx", "idf", "c"]))

    @F.arrow_udf("array<struct<idx:bigint,idf:double,c:bigint>>")
    def counted(arrays: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(arrays.slice(i, COUNTED_ROWS)) for i in range(0, max(1, len(arrays)), COUNTED_ROWS)])

    return counted


def tfidf(docs: DataFrame, vocabulary: DataFrame, row: str = "row_id", tokens: str = "tokens") -> DataFrame:
    """row, idx, value: count over all of the row's tokens (known or not) times idf; no norm.

    The vocabulary has at most ``max_features`` rows and goes to all tasks. Tokens are counted within each row's array, an Arrow batch of rows at a time, whatever
    a task's share of the table. Only where values of ``row`` repeat (looked up first), the counts of rows of equal ``row`` and length are added up, in tasks of about ``MERGED_ROWS`` rows.
    """
    each = docs.select(row, F.size(tokens).alias("n"), F.explode(known_counts(vocabulary)(F.col(tokens))).alias("t"))
    counts = each.select(row, "t.idx", "n", "t.idf", "t.c")
    n, most = docs.groupBy(row).agg(F.count(F.lit(1)).alias("k")).agg(F.sum("k"), F.max("k")).first()
    if (most or 0) > 1:
        keys = (row, "idx", "n", "idf")
        counts = counts.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // MERGED_ROWS)), *keys).groupBy(*keys).agg(F.sum("c").alias("c"))
    return counts.select(row, "idx", (F.col("c") / F.col("n") * F.col("idf")).alias("value"))


def one_hot(docs: DataFrame, encoder: DataFrame, value: Column, base: int, row: str = "row_id") -> DataFrame:
    """row, idx, 1.0 for values that the encoder (at most 100 rows, broadcast) knows."""
    return docs.select(row, value.alias("value")).join(F.broadcast(encoder.select("value", F.col("idx").alias("k"))), "value").select(row, (F.col("k") + base).alias("idx"), F.lit(1.0).alias("value"))


def temporal(docs: DataFrame, stamp: str, base: int, row: str = "row_id") -> DataFrame:
    """row, idx, value of the temporal features that are not 0."""
    values = F.array(*[F.col(c) for c in FEATURES])
    made = docs.select(row, *temporal_features(F.col(stamp)))
    return made.select(row, F.posexplode(values).alias("k", "value")).where("value <> 0").select(row, (F.col("k") + base).cast("long").alias("idx"), "value")


@dataclass
class Assembler:
    """Fitted on training rows: vocabulary, the two encoders, and where their features start."""

    vocabulary: DataFrame
    materia: DataFrame
    tipo: DataFrame
    sizes: tuple[int, int, int]

    @classmethod
    def fit(cls, train: DataFrame, max_features: int, min_df: int) -> Assembler:
        """The fitted tables are small and cached; their sizes give the layout."""
        parts = [fit_vocabulary(train, "tokens", max_features, min_df), fit_category(train, category(F.col("materia")), "materia"), fit_category(train, category(F.col("tipo")), "tipo")]
        parts = [p.cache() for p in parts]
        return cls(*parts, sizes=tuple(p.count() for p in parts))

    @property
    def dimension(self) -> int:
        return sum(self.sizes) + len(FEATURES)

    def transform(self, docs: DataFrame) -> DataFrame:
        """row_id, idx, value: words first, then time, then the two categories. Other columns of ``docs`` are no features."""
        v, m, _ = self.sizes
        parts = [
            tfidf(docs, self.vocabulary),
            temporal(docs, "ts", v),
            one_hot(docs, self.materia, category(F.col("materia")), v + len(FEATURES)),
            one_hot(docs, self.tipo, category(F.col("tipo")), v + len(FEATURES) + m),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


    def vectors(self, docs: DataFrame, *keep: str) -> DataFrame:
        """row_id, the columns of ``keep``, and features (idx ascending, value) of every row of ``docs``.

        Words are counted row by row: where ``docs`` is already dealt by row_id, nothing is shuffled.
        """
        v, m, _ = self.sizes
        pair = lambda idx, value: F.struct(idx.cast("long").alias("idx"), value.cast("double").alias("value"))
        none = F.array().cast("array<struct<idx:bigint,value:double>>")
        words = tfidf(docs, self.vocabulary).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_words"))
        time = F.filter(F.array(*[pair(F.lit(v + i), f) for i, f in enumerate(temporal_features(F.col("ts")))]), lambda x: x["value"] != 0)
        own = docs.select("row_id", *keep, time.alias("_time"), category(F.col("materia")).alias("_materia"), category(F.col("tipo")).alias("_tipo"))
        for name, encoder, base in (("_materia", self.materia, v + len(FEATURES)), ("_tipo", self.tipo, v + len(FEATURES) + m)):
            known = encoder.select(F.col("value").alias(name), F.array(pair(F.col("idx") + base, F.lit(1.0))).alias(f"{name}_at"))
            own = own.join(F.broadcast(known), name, "left")
        joined = own.join(words, "row_id", "left")
        return joined.select("row_id", *keep, F.concat(*[F.coalesce(c, none) for c in ("_words", "_time", "_materia_at", "_tipo_at")]).alias("features"))

    def release(self) -> None:
        """Give the cached tables back."""
        for t in (self.vocabulary, self.materia, self.tipo):
            t.unpersist()


def to_sparse(features: DataFrame, row: str = "row_id") -> DataFrame:
    """row, features (idx ascending, value) as arrays of structs: at most one row's features per group."""
    return features.groupBy(row).agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("features"))
