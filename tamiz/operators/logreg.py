"""Logistic regression: full-batch descent as joins, exact mini-batches block by block, and the library's."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tamiz.operators.ranking import global_rank

#: Feature values of a block of the exact trainer, rows that are packed together, units whose feature values it counts, and feature values up to which full-batch descent does not start a job per epoch.
BLOCK_VALUES, PACK_ROWS, MOST_UNITS, FEW_VALUES = 2_000_000, 1024, 4096, 8_000_000


@dataclass(frozen=True)
class TrainConfig:
    epochs: int = 10
    rate: float = 0.05
    decay: float = 0.001
    batch: int = 1024
    threshold: float = 0.5

    def normalised(self, rows: int) -> TrainConfig:
        """Values that make no sense fall back: epochs to 1, rate to 0.05, batch to all rows, threshold to 0.5."""
        return replace(self, epochs=self.epochs if self.epochs > 0 else 1, rate=self.rate if self.rate > 0 else 0.05, batch=min(self.batch, rows) if self.batch > 0 else rows, threshold=self.threshold if self.threshold > 0 else 0.5)


@dataclass
class Linear:
    """Weights by feature index, and the bias. Bounded by the number of features."""

    weights: dict[int, float]
    bias: float = 0.0

    def frame(self, like: DataFrame) -> DataFrame:
        rows = sorted(self.weights.items()) or [(-1, 0.0)]
        return like.sparkSession.createDataFrame(rows, "idx long, weight double")


def sigmoid(z: Column) -> Column:
    """Stable on both sides."""
    return F.when(z >= 0, 1 / (1 + F.exp(-F.greatest(z, F.lit(0.0))))).otherwise(F.exp(F.least(z, F.lit(0.0))) / (1 + F.exp(F.least(z, F.lit(0.0)))))


def predict(rows: DataFrame, features: DataFrame, model: Linear, threshold: float = 0.5) -> DataFrame:
    """``rows`` (row_id, label) with probability and prediction; rows without features get the bias alone."""
    weights = F.broadcast(model.frame(rows))
    z = features.join(weights, "idx").groupBy("row_id").agg(F.sum(F.col("value") * F.col("weight")).alias("z"))
    p = sigmoid(F.coalesce("z", F.lit(0.0)) + F.lit(model.bias))
    return rows.join(z, "row_id", "left").withColumn("probability", p).withColumn("prediction", (F.col("probability") >= threshold).cast("int")).drop("z")


def packed(rows: DataFrame, features: DataFrame) -> DataFrame:
    """label, idx, value: one row per row of ``rows`` with its features as two arrays; none are empty arrays."""
    pairs = F.sort_array(F.collect_list(F.struct("idx", "value")))
    by_row = features.groupBy("row_id").agg(pairs.alias("f")).select("row_id", F.col("f.idx").alias("idx"), F.col("f.value").alias("value"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return rows.select("row_id", "label").join(by_row, "row_id", "left").select("label", F.coalesce("idx", none("bigint")).alias("idx"), F.coalesce("value", none("double")).alias("value"))


def gradient(frames: Iterator[pd.DataFrame], weights: np.ndarray, bias: float) -> Iterator[pd.DataFrame]:
    """idx, g: the summed gradient of a partition's rows for every feature it has, the bias as the last index."""
    n = len(weights)
    total, seen = np.zeros(n + 1), np.zeros(n + 1, bool)
    for pdf in frames:
        if len(pdf):
            index, value = np.concatenate(pdf["idx"].tolist()).astype(np.int64), np.concatenate(pdf["value"].tolist())
            owner = np.repeat(np.arange(len(pdf)), [len(i) for i in pdf["idx"]])
            z = np.bincount(owner, weights[index] * value, len(pdf)) + bias
            small = np.exp(-np.abs(z))
            error = np.where(z >= 0, 1 / (1 + small), small / (1 + small)) - pdf["label"].to_numpy(np.float64)
            total[:n] += np.bincount(index, error[owner] * value, n)
            total[n] += error.sum()
            seen[index] = seen[n] = True
    at = np.flatnonzero(seen)
    yield pd.DataFrame({"idx": at, "g": total[at]})


def _all_epochs(pdf: pd.DataFrame, dimension: int, config: TrainConfig) -> pd.DataFrame:
    """idx, weights, bias of full-batch descent over all rows at once."""
    w, b = sgd(list(zip(pdf["idx"], pdf["value"], strict=True)), pdf["label"].to_numpy(np.float64), dimension, config)
    seen = np.unique(np.concatenate([np.zeros(0, np.int64), *pdf["idx"]]).astype(np.int64))
    return pd.DataFrame({"idx": [seen.tolist()], "weights": [w[seen].tolist()], "bias": [b]})


def descend(rows: DataFrame, features: DataFrame, config: TrainConfig) -> Linear:
    """Full-batch gradient descent from zero: exact whenever the batch holds all rows.

    Features are packed per row once and kept. See ``descend_packed``.
    """
    return descend_packed(packed(rows, features), config)


def descend_packed(rows: DataFrame, config: TrainConfig) -> Linear:
    """Full-batch descent over ``rows`` (label, idx, value: arrays).

    An epoch is one pass without a shuffle of rows: every partition sums its own gradient, and one value per feature
    reaches the driver. Sets of at most ``FEW_VALUES`` feature values take all epochs in one task, with the same result. Weights decay, the bias does not. A batch of fewer rows than there are is refused:
    ordered batches are what ``sgd_exact`` does.
    """
    kept = rows.persist()
    n, size, held = kept.agg(F.count(F.lit(1)), F.coalesce(F.max(F.array_max("idx")), F.lit(-1)), F.coalesce(F.sum(F.size("idx")), F.lit(0))).first()
    if not n:
        kept.unpersist()
        return Linear({})
    if 0 < config.batch < n:
        kept.unpersist()
        raise ValueError(f"a batch of {config.batch} rows is not the full batch of {n}: use the exact trainer, or a batch of all rows")
    config = config.normalised(n)
    if held <= FEW_VALUES:
        found = kept.groupBy().applyInPandas(lambda pdf: _all_epochs(pdf, size + 1, config), "idx array<long>, weights array<double>, bias double").first()
        kept.unpersist()
        return Linear(dict(zip(found["idx"], found["weights"], strict=True)), found["bias"])
    weights, bias, seen = np.zeros(size + 1), 0.0, set()
    for _ in range(config.epochs):
        step = partial(gradient, weights=weights, bias=bias)
        sums = kept.mapInPandas(step, "idx long, g double").groupBy("idx").agg(F.sum("g").alias("g")).collect()
        total = np.zeros(size + 2)
        for r in sums:
            total[r["idx"]] = r["g"]
        seen.update(r["idx"] for r in sums)
        weights = weights - config.rate * (total[: size + 1] / n + config.decay * weights)
        bias -= config.rate * total[size + 1] / n
    kept.unpersist()
    return Linear({i: float(weights[i]) for i in sorted(seen) if i <= size}, float(bias))


def slopes(labels: np.ndarray, size: np.ndarray, index: np.ndarray, value: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Summed gradient and summed error of rows with ``size`` feature values each."""
    k = len(labels)
    owner = np.repeat(np.arange(k), size)
    z = np.bincount(owner, w[index] * value, k) + b
    p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
    error = p - labels
    return np.bincount(index, error[owner] * value, len(w)), error.sum()


def one_epoch(labels: np.ndarray, size: np.ndarray, index: np.ndarray, value: np.ndarray, w: np.ndarray, b: float, config: TrainConfig) -> tuple[np.ndarray, float]:
    """Weights and bias after one pass over the rows, batch by batch."""
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    for start in range(0, len(labels), config.batch):
        own = size[start : start + config.batch]
        k = len(own)
        part = slice(ends[start], ends[start + k])
        g, e = slopes(labels[start : start + k], own, index[part], value[part], w, b)
        w = w - config.rate * (g / k + config.decay * w)
        b -= config.rate * e / k
    return w, b


def sgd(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimension: int, config: TrainConfig) -> tuple[np.ndarray, float]:
    """Mini-batches in the given order, never shuffled."""
    config = config.normalised(len(labels))
    w, b = np.zeros(dimension), 0.0
    size = np.array([len(i) for i, _ in examples], np.int64)
    all_index = np.concatenate([np.zeros(0, np.int64), *(i for i, _ in examples)]).astype(np.int64)
    all_value = np.concatenate([np.zeros(0), *(v for _, v in examples)])
    for _ in range(config.epochs):
        w, b = one_epoch(labels, size, all_index, all_value, w, b, config)
    return w, b


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order as a few values: block, at (position of the first row), and label, size, idx and value as bytes."""
    for pdf in (pdf[i : i + PACK_ROWS] for pdf in frames for i in range(0, len(pdf), PACK_ROWS)):
        for block, own in pdf.groupby("block"):
            index, value = np.concatenate(own["idx"].tolist()).astype(np.int32), np.concatenate(own["value"].tolist()).astype(np.float64)
            size = own["idx"].map(len).to_numpy(np.int32)
            yield pd.DataFrame({"block": [block], "at": [own["at"].iloc[0]], "label": [own["label"].to_numpy(np.float64).tobytes()], "size": [size.tobytes()], "idx": [index.tobytes()], "value": [value.tobytes()]})


def _opened(rows: Iterator[Row], block: int) -> tuple[np.ndarray, ...]:
    """label, size, idx, value of a block's rows in order."""
    own = sorted((r for r in rows if r["block"] == block), key=lambda r: r["at"])
    kinds = {"label": np.float64, "size": np.int32, "idx": np.int32, "value": np.float64}
    return tuple(np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[name], kind) for r in own)]) for name, kind in kinds.items())


def _learnt(rows: Iterator[Row], block: int, weights: np.ndarray, bias: float, config: TrainConfig) -> Iterator[tuple[np.ndarray, float]]:
    """Weights and bias after a block's batches."""
    labels, size, index, value = _opened(rows, block)
    yield one_epoch(labels, size, index, value, weights, bias, config)


def _sums(rows: Iterator[Row], blocks: list[int], weights: np.ndarray, bias: float) -> Iterator[tuple[np.ndarray, float]]:
    """Summed gradient and error of the rows of ``blocks`` in a partition."""
    held = list(rows)
    for block in blocks:
        labels, size, index, value = _opened(held, block)
        yield slopes(labels, size, index, value, weights, bias)


def _blocks(kept: DataFrame, n: int, held: int, batch: int, most: int) -> list[int]:
    """Positions at which blocks of about ``most`` feature values begin. A batch is cut only if it is larger than a block, and then no block has rows of two.

    Feature values are counted by units of neighbouring rows, at most ``MOST_UNITS`` and those that a large batch is cut into.
    """
    cuts = -(-8 * held * batch // (n * most)) if held * batch > n * most else 1
    group = batch * (1 if cuts > 1 else -(-n // (batch * MOST_UNITS)))
    unit = -(-group // cuts)
    place = F.col("at")
    counts = kept.groupBy(F.floor(place / group).alias("g"), F.floor(place % group / unit).alias("u")).agg(F.sum("held")).collect()
    starts, full = [], 0
    for g, u, size in sorted(tuple(r) for r in counts):
        if not starts or full + size > most or cuts > 1 and not u:
            starts, full = [*starts, g * group + u * unit], 0
        full += size
    return starts


def sgd_exact(sparse: DataFrame, dimension: int, config: TrainConfig, most: int | None = None) -> Linear:
    """The exact order-dependent trainer for any batch size, over a training set (rn, label, features) of any size.

    Rows are dealt by order into blocks of whole batches and about ``BLOCK_VALUES`` feature values, packed and kept. Sequential by nature, as each batch needs
    the weights of the one before: an epoch is a task for each block in turn, which gets the weights that the last one left. A batch larger than a
    block is several blocks, whose tasks sum its gradient side by side. A caller may name a number of feature values, ``most``, beyond which the set is refused.
    """
    rows = sparse.select("rn", "label", F.col("features.idx").cast("array<int>").alias("idx"), F.col("features.value").alias("value"), F.size("features").alias("held")).persist()
    n, first, last, held = rows.agg(F.count(F.lit(1)), F.min("rn"), F.max("rn"), F.coalesce(F.sum("held"), F.lit(0))).first()
    if not n or most is not None and held > most:
        rows.unpersist()
        if not n:
            return Linear({})
        raise ValueError(f"{held} feature values are more than the {most} that one task may hold: use gd with a batch of all rows, or library")
    config = config.normalised(n)
    placed = rows if last - first + 1 == n else global_rank(rows.withColumnRenamed("rn", "_rn"), "_rn", "_rn")
    placed = placed.withColumn("at", F.col("rn") - (first if placed is rows else 1))
    starts = _blocks(placed, n, held, config.batch, BLOCK_VALUES)
    block = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col("at"))) - 1
    dealt = placed.select(block.alias("block"), "at", "label", "idx", "value").repartitionById(len(starts), "block").sortWithinPartitions("at")
    kept = dealt.mapInPandas(_pack, "block int, at long, label binary, size binary, idx binary, value binary").persist()
    home = {r["block"]: r["p"] for r in kept.select("block", F.spark_partition_id().alias("p")).distinct().collect()}
    rows.unpersist()
    run, packs = sparse.sparkSession.sparkContext.runJob, kept.rdd
    batches: dict[int, list[int]] = {}
    for k, s in enumerate(starts):
        batches.setdefault(s // config.batch, []).append(k)
    weights, bias = np.zeros(dimension), 0.0
    for _ in range(config.epochs):
        for b, own in batches.items():
            if len(own) == 1:
                ((weights, bias),) = run(packs, partial(_learnt, block=own[0], weights=weights, bias=bias, config=config), [home[own[0]]])
            else:
                k = min(config.batch, n - b * config.batch)
                sums = run(packs, partial(_sums, blocks=own, weights=weights, bias=bias), sorted({home[i] for i in own}))
                weights = weights - config.rate * (sum(g for g, _ in sums) / k + config.decay * weights)
                bias -= config.rate * sum(e for _, e in sums) / k
    kept.unpersist()
    return Linear({i: float(w) for i, w in enumerate(weights) if w}, float(bias))


def vectors(sparse: DataFrame, dimension: int) -> DataFrame:
    """label and features as sparse library vectors: a row holds the values that it has, whatever the dimension."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    make = F.udf(lambda index, value: SparseVector(dimension, index, value), VectorUDT())
    ordered = F.array_sort("features")
    return sparse.select("row_id", F.col("label").cast("double").alias("label"), make(ordered["idx"], ordered["value"]).alias("features"))


def library(sparse: DataFrame, dimension: int, config: TrainConfig) -> Linear:
    """The scalable trainer: another optimiser for the same penalised risk, the bias free."""
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(maxIter=50, regParam=config.decay, elasticNetParam=0.0, standardization=False, threshold=config.threshold).fit(vectors(sparse, dimension))
    return Linear({i: float(w) for i, w in enumerate(model.coefficients.toArray()) if w}, float(model.intercept))

