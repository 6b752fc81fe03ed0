"""Confusion counts and rates, robust means and timing reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """tp, tn, fp, fn, accuracy, precision, recall, f1, alerts in one pass; other labels than 0 and 1 are not counted."""
    pairs = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}
    counts = df.agg(*[F.count_if((truth == t) & (guess == g)).alias(n) for n, (t, g) in pairs.items()])
    tp, tn, fp, fn = (F.col(n) for n in pairs)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    total = precision + recall
    return counts.select(
        "tp", "tn", "fp", "fn", F.round(ratio(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
        F.round(F.when(total > 0, 2 * precision * recall / F.nullif(total, F.lit(0.0))).otherwise(0.0), 6).alias("f1"), (tp + fp).alias("alerts"),
    )


def trimmed_mean(x: Column) -> Column:
    """Mean without one least and one greatest value; up to two values: the plain mean; none: 0."""
    n = F.count(x)
    return F.when(n > 2, (F.sum(x) - F.min(x) - F.max(x)) / F.nullif(n - 2, F.lit(0))).otherwise(F.coalesce(F.avg(x), F.lit(0.0)))


def processing(total: Column, read: Column) -> Column:
    """Seconds without reading, never below 0."""
    return F.greatest(total - read, F.lit(0.0))


def best(df: DataFrame, config: str, score: str) -> DataFrame:
    """The configuration with the least score, the least configuration of equal ones."""
    return df.agg(F.min(F.struct(score, config)).alias("b")).select(F.col(f"b.{config}").alias(config), F.col(f"b.{score}").alias(score))
