"""Steps whose tasks must not grow with the input."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext

from tamiz.operators import features, logreg, vocab


@pytest.mark.parametrize(("batch", "most", "blocks"), [(4, 30, 5), (4, 5, 28), (15, 24, 6), (0, 24, 6), (4, 10**6, 1)])
def test_ordered_batches_in_bounded_blocks(spark, monkeypatch, batch, most, blocks):
    """Blocks of whole batches, of parts of a large batch, one block: the result of plain numpy, no task with more than a block, gaps in the order and empty rows too."""
    rng = np.random.default_rng(5)
    rows = [(10 * i - 7, int(rng.integers(0, 2)), [(j, float(rng.random())) for j in range(7) if (i + j) % 2 and i != 11]) for i in range(40)]
    config = logreg.TrainConfig(3, 0.5, 0.01, batch)
    w, b = logreg.sgd([(np.array([j for j, _ in f], int), np.array([v for _, v in f])) for _, _, f in rows], np.array([y for _, y, _ in rows], float), 7, config)
    sparse = spark.createDataFrame(rows, "rn long, label int, features array<struct<idx:bigint,value:double>>").repartition(5)
    ran, plain = [], SparkContext.runJob
    monkeypatch.setattr(logreg, "BLOCK_VALUES", most, raising=False)
    monkeypatch.setattr(SparkContext, "runJob", lambda self, rdd, f, parts=None, **x: ran.append(parts) or plain(self, rdd, f, parts, **x))
    model = logreg.sgd_exact(sparse, 7, config)
    assert [model.weights[j] for j in range(7)] == pytest.approx(w.tolist(), abs=1e-12) and model.bias == pytest.approx(b)
    assert len({p for own in ran for p in own}) >= blocks and sum(map(len, ran)) == 3 * len({p for own in ran for p in own})
    assert not logreg.sgd_exact(sparse.limit(0), 7, config).weights


def test_counts_within_a_row(spark):
    """Repeated, missing and no tokens; ids that repeat are added up where the number of tokens is equal, as GROUP BY does."""
    words = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 2.0)], "token string, idx long, idf double")
    shape = "row_id long, tokens array<string>"
    rows = spark.createDataFrame([(1, ["b", "a", "b", "x"]), (2, []), (3, None), (4, [None, "a", None]), (5, ["x"])], shape)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    once = features.tfidf(rows, words)
    assert key(once) == [(1, 0, 0.25), (1, 1, 1.0), (4, 0, 1 / 3)]
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan
    twice = rows.union(spark.createDataFrame([(1, ["a", "a", "b", "b"]), (1, ["a"]), (None, ["b"]), (None, ["b"])], shape))
    assert key(features.tfidf(twice.where("row_id = 1"), words)) == [(1, 0, 0.75), (1, 0, 1.0), (1, 1, 2.0)]
    assert [r["value"] for r in features.tfidf(twice, words).where("row_id IS NULL").collect()] == [4.0]
    many = spark.range(3000).repartition(1).selectExpr("id AS row_id", "array_repeat(IF(id % 2 = 0, 'a', 'z'), 1 + CAST(id % 3 AS INT)) AS tokens")
    assert key(features.tfidf(many, words)) == [(i, 0, 1.0) for i in range(0, 3000, 2)]
    assert features.tfidf(rows.limit(0), words).count() == 0 and features.tfidf(rows, words.limit(0)).count() == 0


def test_document_frequency_in_bounded_parts(spark, monkeypatch):
    """Counts are given out part by part and added up by more tasks where there are more tokens."""
    rows = spark.createDataFrame([(i, [f"w{i % 7}", "all", "all", "", f"only{i}"]) for i in range(100)], "row_id long, tokens array<string>").repartition(3)
    part = pa.RecordBatch.from_arrays([pa.array(["a", "b", "a"])], ["token"])
    monkeypatch.setattr(vocab, "COMBINE_BYTES", 2 * part.nbytes, raising=False)
    assert [b.to_pydict() for b in vocab._combined(iter([part] * 3))] == [{"token": ["a", "b"], "c": [4, 2]}, {"token": ["a", "b"], "c": [2, 1]}]
    monkeypatch.setattr(vocab, "TASK_TOKENS", 50, raising=False)
    found = vocab.document_frequency(rows)
    assert {r["token"]: r["df"] for r in found.collect()} == {"all": 100, **{f"w{k}": 15 if k < 2 else 14 for k in range(7)}}
    assert found.rdd.getNumPartitions() == 10
    assert vocab.document_frequency(rows.limit(0)).count() == 0 and vocab.document_frequency(rows, min_df=0).count() == 108
