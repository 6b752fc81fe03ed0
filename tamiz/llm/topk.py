"""Exact top-k inner products with MaxScore.

Every vector component is a term, and a stretch of candidates holds the postings of a term as one
contiguous row with its least and greatest impact. For a query, terms are ordered
by their score bounds. The lowest ones whose bounds together stay under the
threshold (the k-th best score so far) are non-essential: a candidate that the
essential postings leave without enough score cannot reach the result through them.
Essential postings are traversed for the whole stretch; the others are probed in
turn, only for candidates that are still competitive. Candidates stay where they are: blocks of queries of
checked size go to them, a task carries its thresholds on, and shards are merged at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.common import materialise, new_table, write

SCALE = 1024
K = 10
QUERY_EVERY = 100
#: A block of queries has at most so many, and at most so many bytes of components; it is sent to all tasks.
BLOCK_QUERIES, BLOCK_BYTES = 4096, 8 << 20
#: Candidates between two updates of the threshold.
STRIDE = 2048
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: Candidates whose postings are laid out at once.
SHARD_ROWS = 4096
RESULT = "query int, query_id long, vec_id long, score long"


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id and terms (floor(1024 x), whole numbers as doubles) of the vectors that take part.

    Vectors that are null or hold a null, NaN or infinite component take no part, nor
    do rows without a vec_id, nor those of which a component times 1024 is not finite. Empty vectors score 0 against everything.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < F.lit(float("inf"))))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    whole = lambda x: F.when(F.abs(x.cast("double") * SCALE) >= EXACT, x.cast("double") * SCALE).otherwise(F.floor(x.cast("double") * SCALE).cast("double"))  # noqa: E731 # from 2^53 on doubles are whole
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("terms"))


def _matrix(terms: pd.Series | list, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width``: a missing component adds nothing."""
    rows = list(terms)
    if rows and all(len(t) == width for t in rows):
        return np.stack(rows).astype(np.float64, copy=False)
    out = np.zeros((len(rows), width))
    for row, t in zip(out, rows, strict=True):
        row[: len(t)] = t
    return out


def _whole(matrix: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers of any size."""
    return np.array([[int(x) for x in row] for row in matrix], object).reshape(matrix.shape)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.dtype == object:  # integers beyond 64 bits
        order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    else:
        order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def maxscore(postings: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int = K, best_ids: np.ndarray | None = None, best: np.ndarray | None = None, work: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the ``k`` best rows other than ``own``. postings: one row per term, a column per candidate.

    ``best_ids`` and ``best`` are what earlier postings gave, so that the threshold is carried on. ``work`` counts the
    products that were made, and those that all postings would need.
    """
    low, high = postings.min(axis=1), postings.max(axis=1)
    bounds = np.maximum(query * low, query * high)
    order = np.argsort(-bounds, kind="stable")
    order = order[query[order] != 0]  # terms that the query lacks have no postings to read
    ordered, q = postings[order], query[order]
    rest = np.concatenate([np.cumsum(bounds[order][::-1])[::-1], [0]])  # bound on the terms from each place on
    most = np.concatenate([np.maximum.accumulate(rest[::-1])[::-1], [0]])
    if best is None:
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, postings.dtype)
    for start in range(0, postings.shape[1], STRIDE):
        at = np.arange(start, min(start + STRIDE, postings.shape[1]))
        full = len(best) == k
        threshold = best[-1] if full else None
        essential = len(order) if not full else int(np.argmax(np.append(most[:-1] < threshold, True))) if threshold > 0 else len(order)
        score = q[:essential] @ ordered[:essential, start : start + STRIDE]
        made = essential * len(at)
        for place in range(essential, len(order)):
            alive = np.flatnonzero(score + rest[place] >= threshold)
            if len(alive) < len(at):
                at, score = at[alive], score[alive]
            if not len(at):
                break
            made += len(at)
            score = score + q[place] * ordered[place, at]
        if work is not None:
            work += (made, len(order) * min(STRIDE, postings.shape[1] - start))
        alive = ids[at] != own
        if full:
            alive &= (score >= threshold).astype(bool)
        if alive.any():
            at, score = at[alive], score[alive]
            if len(at) > 4 * k and score.dtype != object:  # only those that reach the k-th best of these
                enough = score >= np.partition(score, len(score) - k)[len(score) - k]
                at, score = at[enough], score[enough]
            best_ids, best = _top(np.concatenate([best_ids, ids[at]]), np.concatenate([best, score]), k)
    return best_ids, best


class Search:
    """One task's search: a block of queries, and the best candidates of each so far."""

    def __init__(self, queries: list[tuple[int, list[float]]], k: int) -> None:
        self.own, self.k = [i for i, _ in queries], k
        self.width = max((len(t) for _, t in queries), default=0)
        self.queries = _matrix([t for _, t in queries], self.width)
        self.norm = np.abs(self.queries).sum(axis=1) if self.width else np.zeros(len(queries))
        self.best: list = [(None, None)] * len(queries)
        self.work = np.zeros(2, np.int64)

    def add(self, ids: np.ndarray, terms: list) -> None:
        """Candidates; components that either side lacks add nothing. Where sums could leave the exact range of doubles, integers of any size take over."""
        if not len(ids):
            return
        shared = min(self.width, max(len(t) for t in terms))
        postings = np.ascontiguousarray(_matrix([t[:shared] for t in terms], shared).T)
        largest = np.abs(postings).max(initial=0.0)
        whole = None
        for i, own in enumerate(self.own):
            found, mine, query = self.best[i], postings, self.queries[i, :shared]
            if self.norm[i] * largest >= EXACT or (found[1] is not None and found[1].dtype == object):
                whole = _whole(postings) if whole is None else whole
                mine, query = whole, _whole(query[None, :])[0]
                if found[1] is not None and found[1].dtype != object:
                    found = found[0], _whole(found[1][None, :])[0]
            self.best[i] = maxscore(mine, ids, query, own, self.k, *found, work=self.work)

    def result(self) -> Iterator[pd.DataFrame]:
        for i, (own, (ids, best)) in enumerate(zip(self.own, self.best, strict=True)):
            if ids is not None and len(ids):
                scores = np.array([max(-LONG - 1, min(LONG, int(x))) for x in best], np.int64)
                yield pd.DataFrame({"query": i, "query_id": own, "vec_id": ids, "score": scores})


def _hits(vectors: DataFrame, block: list[tuple[int, list[float]]], k: int, shard_rows: int) -> DataFrame:
    """The best candidates of every partition for a block of queries."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Search(block, k)
        for pdf in frames:
            ids, terms = pdf["vec_id"].to_numpy(), pdf["terms"].tolist()
            for start in range(0, len(ids), shard_rows):
                state.add(ids[start : start + shard_rows], terms[start : start + shard_rows])
        found = list(state.result())
        if found:
            yield pd.concat(found)

    return vectors.mapInPandas(search, RESULT)


def top_k(embeddings: DataFrame, k: int = K, query_every: int = QUERY_EVERY, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's ``k`` best candidates, ties to smaller ids.

    Queries are the rows whose vec_id is divisible by ``query_every``; candidates all rows but
    those with the query's own vec_id. A repeated vec_id is a candidate as often as it
    occurs and one query per different vector. Fewer than ``k`` candidates: all of them. Vectors of unequal length meet in
    the components that both have. Scores are exact; those beyond a long are ranked within a task and then given as the end of its range.

    Candidates are read once per block and never shuffled. A block holds at most ``block_queries``
    queries and ``block_bytes`` bytes; what is shuffled are ``k`` rows per query and task.
    """
    vectors = materialise(quantised(embeddings), "vectors")
    queries = materialise(vectors.where(F.col("vec_id") % query_every == 0).distinct(), "queries")
    n, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("terms")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / max(1, min(block_queries, block_bytes // (8 * max(1, width))))))
    best_first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    path = new_table(embeddings.sparkSession, "hits")
    for b in range(blocks):
        chosen = queries.where(F.pmod(F.xxhash64("vec_id", "terms"), F.lit(blocks)) == b) if blocks > 1 else queries
        block = [(r["vec_id"], r["terms"]) for r in chosen.collect()]  # about ``block_bytes``
        ranked = _hits(vectors, block, k, shard_rows).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
        write(ranked.select("query_id", "rank", "vec_id", "score"), path, "append")
    return embeddings.sparkSession.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)
