"""The documented rule-based detector, thresholds as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DUPLICATES, GHOST_COUNT, GHOST_MARK = 20_000, 3, "EMPRESA_FANTASMA_"


def frequent(df: DataFrame, value: str, least: int, name: str) -> DataFrame:
    """Add ``name``: whether a row's value occurs ``least`` times at least.

    The values are counted with partial sums and only the frequent ones are joined back, so no
    task gathers the rows of a value.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    seen = counts.select(F.col(value).alias("_v"), F.lit(True).alias("_hit"))
    return df.join(seen, df[value].eqNullSafe(F.col("_v")), "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_v", "_hit")


def night(ts: Column) -> Column:
    """From midnight to before five."""
    return F.coalesce(F.hour(ts).between(0, 4), F.lit(False))


def detect(df: DataFrame, text: str, ts: str, entity: str, duplicates: int = DUPLICATES, ghost: int = GHOST_COUNT, mark: str = GHOST_MARK) -> DataFrame:
    """Add r_duplicate, r_bombing (the same threshold), r_night, r_ghost and alert."""
    counted = frequent(frequent(df, text, duplicates, "r_duplicate"), entity, ghost, "_many")
    ghostly = F.col("_many") & F.coalesce(F.contains(F.col(entity), F.lit(mark)), F.lit(False))
    rules = counted.withColumns({"r_bombing": F.col("r_duplicate"), "r_night": night(F.col(ts)), "r_ghost": ghostly})
    return rules.withColumn("alert", F.col("r_duplicate") | F.col("r_bombing") | F.col("r_night") | F.col("r_ghost")).drop("_many")
