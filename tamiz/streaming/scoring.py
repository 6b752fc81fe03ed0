"""Scoring complaints as they arrive: an optional extension beyond the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import tokens
from tamiz.operators.logreg import Linear, sigmoid


def once_each(stream: DataFrame, key: str, stamp: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; state is dropped as the watermark passes."""
    return stream.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key])


def score(stream: DataFrame, vocabulary: DataFrame, model: Linear, threshold: float = 0.5) -> DataFrame:
    """Rows (text) with probability and prediction from words alone, without state.

    The vocabulary (bounded by its size limit) travels as one map literal per plan, so a micro-batch
    neither joins nor shuffles.
    """
    weights = {r["token"]: r["idf"] * model.weights.get(r["idx"], 0.0) for r in vocabulary.select("token", "idx", "idf").collect()}
    used = [x for token, w in sorted(weights.items()) if w for x in (F.lit(token), F.lit(float(w)))]
    table = F.create_map(*used) if used else F.create_map().cast("map<string,double>")
    words = F.col("_tokens")
    z = F.aggregate(words, F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(table, x), F.lit(0.0))) / F.greatest(F.size(words), F.lit(1))
    out = stream.withColumn("_tokens", tokens(F.col("text"), True)).withColumn("probability", sigmoid(z + F.lit(model.bias)))
    return out.withColumn("prediction", (F.col("probability") >= threshold).cast("int")).drop("_tokens")


def alerts_by_window(stream: DataFrame, stamp: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Alerts and rows per tumbling window; late rows beyond the watermark are dropped."""
    return stream.withWatermark(stamp, delay).groupBy(F.window(stamp, width)).agg(F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("alerts"))
