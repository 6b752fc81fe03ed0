"""Tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables below this size and of fewer files than cores are dealt out when read.
SMALL_BYTES = 24 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is small and in few files: one row group would else be one task.

    Large tables are left alone; their splits are parallel as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
