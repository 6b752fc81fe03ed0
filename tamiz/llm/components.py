"""Connected components by alternating large and small stars, as grouped minima and joins.

Nothing is gathered per node: minima are partial sums, and the join that carries them
back to the edges leaves those of nodes with very many where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import keyed_join, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (u, v: long); the label is the least node of its component.

    Loops and repeated edges are allowed. No edges: no rows. Each round halves long
    chains; rounds stop when the edges no longer change.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
        large = keyed_join(both, materialise(least, "least"), ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(lowest.withColumnRenamed("m", "v")).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    """Tells whether two sets of edges differ."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
