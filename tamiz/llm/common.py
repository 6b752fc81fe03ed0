"""What several operators share: shared-folder tables, size-checked joins, ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most so many narrow rows.
BROADCAST_ROWS = 200_000


def shared_folder(configured: str | None, master: str) -> str:
    """The folder that all executors share. Without one, a temporary folder does for a session that is a single process; for any other master it is an error."""
    if configured:
        return configured.rstrip("/")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    return "file://" + tempfile.mkdtemp(prefix="tamiz-")


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset in a local session (as in tests) a temporary folder is made and set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(found, spark.sparkContext.master)
    if not found:
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Lets Spark delete the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bounds the batches that Python workers hold, however long the documents are.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
DURING_WRITES = {CLEANUP: "true", BATCH: "16m"}


def new_table(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other table has; ``release`` deletes what is written there."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables().append(path)
    return path


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``df`` as Parquet. Shuffle files that this needed are deleted as it ends, as nothing reads them again, and Python workers get batches of bounded size."""
    spark = df.sparkSession
    before = {k: spark.conf.get(k) for k in DURING_WRITES}
    for k, v in DURING_WRITES.items():
        spark.conf.set(k, v)
    try:
        df.write.mode(mode).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back.

    This cuts lineage: a lost executor costs one task, not the stages before,
    and values such as generated row ids no longer change on a retry.
    """
    path = new_table(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that the current run wrote, oldest first. A thread has a list of its own, and so has every ``own_tables`` block.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def _tables() -> list[str]:
    found = _made.get()
    if found is None:
        _made.set(found := [])
    return found


@contextmanager
def own_tables() -> Iterator[None]:
    """What is written inside is not released by a run outside, nor the other way round."""
    token = _made.set([])
    try:
        yield
    finally:
        _made.reset(token)


def made() -> int:
    """How many written tables of this run are still there."""
    return len(_tables())


def release(spark: SparkSession, keep: int = 0, since: int = 0, read_by: DataFrame | None = None) -> None:
    """Delete this run's tables after the first ``since``, but for the last ``keep`` and for those that ``read_by`` reads."""
    jvm, conf, mine = spark._jvm, spark._jsc.hadoopConfiguration(), _tables()
    gone = mine[since : max(since, len(mine) - keep)]
    if read_by is not None:
        read = {part for f in read_by.inputFiles() for part in unquote(f).split("/")}
        gone = [path for path in gone if path.rpartition("/")[2] not in read]
    for path in gone:
        mine.remove(path)
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def releasing(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, with the tables deleted that it wrote on its way and its result does not read."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with own_tables():
            result = query(spark, sf_dir)
            release(spark, read_by=result)
            return result

    return run


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few, else as it is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def ordered_rank(df: DataFrame, order: Column, name: str = "rank") -> DataFrame:
    """Add ``name``: the place of every row in ``order`` (a total one) from 0, without a task that holds all rows.

    Rows are dealt by ranges, written, ranked within their range, and shifted by the sizes of the ranges before.
    """
    dealt = materialise(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1)
    return inner.join(F.broadcast(shift), "_range").withColumn(name, (F.col("_in") + F.col("_shift")).cast("long")).drop("_range", "_in", "_shift")


#: Keys that hold more than one row in so many are joined by a broadcast: there cannot be more of them than this.
HOT_KEYS = 1000


def keyed_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Left join of ``rows`` (written, keys not null) with ``table``, which has one row per key, without gathering a key's rows.

    ``weight`` is the number of rows of a key. The rows of the few keys that hold more than a
    ``HOT_KEYS``-th of all stay where they are, as those keys are broadcast; the others are shuffled.
    """
    least = rows.count() / HOT_KEYS
    hot = F.broadcast(table.where(F.col(weight) > least))
    near = rows.join(hot, keys)
    far = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(weight) <= least), keys, "left")
    return near.unionByName(far)


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, salts: int, name: str = "rank", also: DataFrame | None = None) -> DataFrame:
    """Add ``name``: a gapless rank from 0 within ``keys`` (not null), without gathering a key.

    Rows of a key are dealt over ``salts`` sub-groups; each is ranked on its own and
    shifted by the sizes of the sub-groups before it. The table of sub-group
    sizes is the only thing that is summed along a key. Columns of ``also`` (one row
    per key) come along with that table; rows whose key it lacks are dropped.
    """
    by = [*keys, "_salt"]
    dealt = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    inner = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if also is not None:
        shift = shift.join(also, keys)
    return inner.join(shift, by).withColumn(name, (F.col("_in") + F.col("_shift")).cast("long")).drop("_in", "_shift", "_salt")


#: Stands for a null id while pandas holds the column, so that it stays an integer.
NULL_ID = -(2**63)


def id_in(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def id_out(column: Column) -> Column:
    return F.when(column != NULL_ID, column)
