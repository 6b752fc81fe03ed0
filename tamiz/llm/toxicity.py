"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word pieces is trained in numpy from confirmed
toxic documents and unlabelled ones. The risk estimator corrects for the toxic documents
among the unlabelled by the class prior, and is kept from turning negative. The
model is a bounded array; scoring is one narrow pass over all texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import id_in, id_out, materialise

WORD = re.compile(r"[^\W\d_]+")
#: Features are hashed to so many places: what training counts over, and the bound of the model.
DIMENSION = 1 << 20
#: Bounds of the training sample: confirmed toxic and unlabelled documents, taken in hash order.
POSITIVES, UNLABELLED = 4000, 12000
GRAMS = (4, 5)
#: A feature takes part if it is in so many confirmed documents, is more frequent there by so many
#: standard errors, and if by the prior so great a share of all documents with it is toxic.
LEAST_COUNT, LEAST_Z, LEAST_SHARE = 3, 4.0, 0.4
#: Words that are remembered, and the longest of them: longer runs of letters are worked out anew each time.
CACHED_WORDS, LONGEST_CACHED = 300_000, 40
EPOCHS, BATCH, RATE, DECAY = 15, 512, 0.005, 1e-3
THRESHOLD = 0.3
#: Fold that is never learnt from: crc32 of the id, mod 4.
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def word_features(word: str, dimension: int = DIMENSION) -> set[int]:
    """Hashed indices of a word of any length: itself, and its character n-grams with both ends marked."""
    w = f"^{word}$"
    names = {w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)}
    names.add(w)
    return {crc32(x.encode("utf-8", "surrogatepass")) % dimension for x in names}


class Features:
    """Distinct feature indices of texts; with ``wanted``, only those (a word without any costs a lookup)."""

    def __init__(self, dimension: int = DIMENSION, wanted: set[int] | None = None) -> None:
        self.dimension, self.wanted = dimension, wanted
        self.words: dict[str, frozenset[int]] = {}

    def features(self, word: str) -> frozenset[int]:
        found = word_features(word, self.dimension)
        return frozenset(found if self.wanted is None else found & self.wanted)

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(WORD.findall((text or "").lower()))
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        long = {w for w in words if len(w) > LONGEST_CACHED}
        words -= long
        for w in words:
            if w not in self.words:
                self.words[w] = self.features(w)
        index = frozenset().union(*map(self.words.__getitem__, words), *map(self.features, long))
        return np.fromiter(index, np.int32, len(index))


@dataclass
class Model:
    """Bias, and the weights of the features that take part."""

    index: np.ndarray
    weights: np.ndarray
    bias: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def enriched(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Features that are more frequent among confirmed documents, and their log ratios."""
    none = [np.zeros(0, np.int64)]
    p, u = (np.bincount(np.concatenate(rows or none), minlength=dimension) for rows in (positive, unlabelled))
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    rate = (p + u) / (n_p + n_u)
    z = (p / n_p - u / n_u) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n_p + 1 / n_u))
    ratio = ((p + 0.5) / (n_p + 1)) / ((u + 0.5) / (n_u + 1))
    index = np.flatnonzero((p >= LEAST_COUNT) & (z >= LEAST_Z) & (prior * ratio >= LEAST_SHARE))
    return index, np.log(np.maximum(ratio[index], 1.01))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, dimension: int = DIMENSION, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, decay: float = DECAY, seed: int = 7) -> Model:
    """Minimise ``prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])`` with logistic loss.

    Adam on mini-batches over enriched features scaled by their log ratios. Where the
    second part is negative on a batch, the step goes up its gradient instead, which
    undoes the overfit. Without confirmed documents every score is the prior.
    """
    index, ratio = enriched(positive, unlabelled, clipped(prior), dimension)
    find = places(index)
    return descend(index, ratio, [find(r) for r in positive], [find(r) for r in unlabelled], prior, epochs, batch, rate, decay, seed)


def places(index: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Turns features into their places in ``index`` (ascending); those that take no part are left out."""

    def find(features: np.ndarray) -> np.ndarray:
        at = np.searchsorted(index, features)
        at[at == len(index)] = 0
        return at[index[at] == features] if len(index) else at[:0]

    return find


def clipped(prior: float) -> float:
    return min(max(prior, 1e-3), 0.999)


def descend(index: np.ndarray, ratio: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, decay: float = DECAY, seed: int = 7) -> Model:
    """The descent itself, over rows of places in ``index``."""
    rng = np.random.default_rng(seed)
    prior = clipped(prior)
    n, bias = len(index), float(np.log(prior / (1 - prior)))
    weights = np.zeros(n)
    if not n or not unlabelled:
        return Model(index, weights, bias)
    m, v, mb, vb, step = np.zeros(n), np.zeros(n), 0.0, 0.0, 0
    n_p = max(8, min(len(positive), batch // 2))
    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for start in range(0, len(order), batch):
            rows = [positive[i] for i in rng.choice(len(positive), n_p, replace=len(positive) < n_p)]
            rows += [unlabelled[i] for i in order[start : start + batch]]
            at = np.concatenate(rows)
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            g = np.bincount(owner, (weights * ratio)[at], len(rows)) + bias
            p, k = _sigmoid(g), len(rows) - n_p
            loss = np.logaddexp(0, g)  # l(-g)
            slope = np.empty(len(rows))
            if loss[n_p:].mean() >= prior * loss[:n_p].mean():
                slope[:n_p], slope[n_p:] = -prior / n_p, p[n_p:] / k
            else:
                slope[:n_p], slope[n_p:] = prior * p[:n_p] / n_p, -p[n_p:] / k
            grad = np.bincount(at, slope[owner], n) * ratio + decay * weights
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * slope.sum(), 0.999 * vb + 0.001 * slope.sum() ** 2
            size = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            weights = np.maximum(weights - size * m / (np.sqrt(v) + 1e-8), 0)  # evidence only adds
            bias -= size * mb / (np.sqrt(vb) + 1e-8)
    return Model(index, weights * ratio, float(bias))


def training_sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[DataFrame, float]:
    """doc_id, text, confirmed of the bounded sample, and the class prior.

    One row per document and part: where rows repeat an id, the one whose text has the least hash. Neither the held-out
    fold's labels nor its texts are used. The prior is the toxic share of the other labels (a half smoothing count each way).
    """
    learnt = labels.where(~held_out(labels["doc_id"])).where("doc_id is not null and toxic in (0, 1)")
    toxic, known = learnt.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    chosen = lambda ids, n: ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    confirmed = chosen(learnt.where("toxic = 1"), positives).withColumn("confirmed", F.lit(True))
    other = chosen(docs.where(~held_out(docs["doc_id"])).where("doc_id is not null"), unlabelled).withColumn("confirmed", F.lit(False))
    ids = F.broadcast(materialise(confirmed.unionByName(other), "sample"))  # at most the two bounds together
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = own.join(ids.select("doc_id").distinct(), "doc_id")
    first = found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return first.join(ids, "doc_id").select("doc_id", "text", "confirmed"), (float(toxic) + 0.5) / (known + 1)


def feature_rows(sample: DataFrame) -> DataFrame:
    """confirmed and features (4 bytes each) of the sample's documents; written, as several passes read them."""

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features()
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "confirmed": pdf["confirmed"], "features": [make(t).astype("<i4").tobytes() for t in pdf["text"]]})

    return materialise(sample.mapInPandas(features, "doc_id long, confirmed boolean, features binary"), "features")


def enriched_features(rows: DataFrame, prior: float, dimension: int = DIMENSION) -> tuple[np.ndarray, np.ndarray]:
    """What ``enriched`` gives, over ``feature_rows``: partitions count features and the counts are summed; features that take part reach the driver."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, u = np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for pdf in frames:
            for confirmed, found in zip(pdf["confirmed"], pdf["features"], strict=True):
                (p if confirmed else u)[np.frombuffer(found, "<i4")] += 1  # a document has a feature once
        at = np.flatnonzero(p + u)
        for start in range(0, len(at), 65536):
            some = at[start : start + 65536]
            yield pd.DataFrame({"feature": some, "p": p[some], "u": u[some]})

    n_p, n_u = rows.agg(F.count_if("confirmed"), F.count_if(~F.col("confirmed"))).first()
    n_p, n_u = float(max(1, n_p)), float(max(1, n_u))
    counts = rows.select("confirmed", "features").mapInPandas(counted, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-12)) * (1 / n_p + 1 / n_u))
    ratio = ((F.col("p") + 0.5) / (n_p + 1)) / ((F.col("u") + 0.5) / (n_u + 1))
    chosen = counts.where((F.col("p") >= LEAST_COUNT) & (z >= LEAST_Z) & (ratio * clipped(prior) >= LEAST_SHARE))
    found = chosen.select("feature", F.log(F.greatest(ratio, F.lit(1.01))).alias("ratio")).orderBy("feature").collect()  # fewer than ``dimension``
    return np.array([r["feature"] for r in found], np.int64), np.array([r["ratio"] for r in found], np.float64)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Features are made and counted where the sample's texts are. One task trains on the few that take part, and the model comes back."""
    sample, prior = training_sample(docs, labels)
    rows = feature_rows(sample)
    index, ratio = enriched_features(rows, prior)

    def shorten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = places(index)
        for pdf in frames:
            yield pdf.assign(features=[find(np.frombuffer(x, "<i4")).astype("<i4").tobytes() for x in pdf["features"]])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confirmed", "doc_id"])
        part = lambda confirmed: [np.sort(np.frombuffer(x, "<i4")) for x in pdf.loc[pdf["confirmed"] == confirmed, "features"]]
        model = descend(index, ratio, part(True), part(False), prior)
        return pd.DataFrame({"weights": [model.weights.tolist()], "bias": [model.bias]})

    short = rows.mapInPandas(shorten, rows.schema)
    found = short.groupBy().applyInPandas(learn, "weights array<double>, bias double").first()
    if found is None:
        return Model(index, np.zeros(len(index)), float(np.log(clipped(prior) / (1 - clipped(prior)))))
    return Model(index, np.array(found["weights"], np.float64), found["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; null and empty texts have the score of no evidence."""
    weights = dict(zip(model.index.tolist(), model.weights.tolist(), strict=True))
    bias = model.bias

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features(wanted=set(weights))
        for pdf in frames:
            margins = [bias + math.fsum(map(weights.__getitem__, make(t).tolist())) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": _sigmoid(np.array(margins, np.float64))})

    rows = docs.select(id_in(docs["doc_id"]).alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInPandas(batches, "doc_id long, score double").withColumn("doc_id", id_out(F.col("doc_id")))


def detect(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Repeated rows are scored alike; ids without labels are fine; no labels or no documents give
    scores of the prior or no rows. Other columns of either table are ignored.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
