"""Order over a whole table without a single task: ranks, splits, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A range holds about so many rows, and there are at most so many ranges.
RANGE_ROWS, MOST_RANGES = 500_000, 4096


def _cuts(order: Column, rows: int) -> Column:
    """Where to cut ``order`` into ranges: more of them for more rows."""
    ranges = min(MOST_RANGES, max(8, -(-rows // RANGE_ROWS)))
    return F.percentile_approx(order.cast("double"), [i / ranges for i in range(1, ranges)], 10_000)


def global_rank(df: DataFrame, order: str, tie: str, cuts: list[float] | None = None) -> DataFrame:
    """Add ``rn``, the rank from 1 by (``order``, ``tie``).

    Approximate quantiles of ``order`` (``cuts``, where they are known) cut the table into ranges; rows are ranked within their
    range and shifted by the counts of the ranges before. Rows of one ``order`` value share a
    range, so a value that most rows hold wants a finer ``order``.
    """
    if cuts is None:
        cuts = df.agg(_cuts(F.col(order), df.count())).first()[0] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    dealt = df.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(order).cast("double"))))
    within = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(order, tie)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return within.join(F.broadcast(shift), "_range").withColumn("rn", (F.col("_in") + F.col("_before")).cast("long")).drop("_range", "_in", "_before")


def test_rows(n: int, ratio: float) -> int:
    """Size of the test tail: half away from zero, at least 1 and at most n - 1. Fewer than two rows are an error."""
    if n < 2:
        raise ValueError("a split needs two rows at least")
    share = ratio if 0 < ratio < 1 else 0.2
    return min(max(int(n * share + 0.5), 1), n - 1)


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle: 64 bits of a digest of seed and key as a long."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def split(df: DataFrame, order: str, tie: str, ratio: float = 0.2, n: int | None = None, cuts: list[float] | None = None) -> DataFrame:
    """Add ``rn`` and ``part`` (train or test): the tail of the order is the test set."""
    n = df.count() if n is None else n
    cut = n - test_rows(n, ratio)
    return global_rank(df, order, tie, cuts).withColumn("part", F.when(F.col("rn") <= cut, "train").otherwise("test"))


def split_records(df: DataFrame, stamp: str, key: str, ratio: float = 0.2, seed: int = 42) -> tuple[DataFrame, str]:
    """Temporal split if every row has a stamp, else one by a seeded hash of the key; and which it was.

    One pass counts rows and missing stamps, a second one cuts the order that is chosen into ranges.
    """
    n, missing = df.agg(F.count(F.lit(1)), F.count_if(F.col(stamp).isNull())).first()
    order = hash_order(F.col(key), seed) if missing else F.unix_micros(F.col(stamp).cast("timestamp"))
    ordered = df.withColumn("_order", order)
    cuts = ordered.agg(_cuts(F.col("_order"), n)).first()[0] or []
    return split(ordered, "_order", key, ratio, n, cuts).drop("_order"), "random" if missing else "temporal"


def batch_id(rank: Column, size: int) -> Column:
    """Mini-batch of a rank from 1."""
    return F.floor((rank - 1) / size).cast("long")
