"""Sharding by fixed virtual slots, DataFrame functions only.

Records hash into thousands of virtual slots for good. Bytes and rows are summed
per slot, and a versioned table maps slots to shards. Only that table (at most
``VIRTUAL_SLOTS`` rows whatever the corpus size) is edited when shards are
rebalanced, so a record moves only if its slot moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.llm.common import keyed_join, materialise, new_table

VIRTUAL_SLOTS = 4096
SHARDS = 40
OVERHEAD = 16


def record_sizes(docs: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row; the text is read once and dropped.

    Null text: no bytes, checksum 0. The slot hashes doc_id with the checksum, so rows
    that share a null or repeated doc_id still spread. Rows that repeat both are told apart by
    a row number, so that they spread too.
    """
    raw = F.coalesce(F.encode(docs["text"].cast("string"), "UTF-8"), F.lit(b""))
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.monotonically_increasing_id().alias("row_id"))
    rows = materialise(narrow, "sizes")
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(slots)).cast("int")
    own = rows.select("doc_id", "size", "text_crc32", slot("doc_id", "text_crc32").alias("virtual_slot"), "row_id")
    alike = ["doc_id", "text_crc32", "size"]
    repeated = materialise(rows.groupBy(*alike).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.xxhash64(*alike).alias("_key"), "_n"), "repeated")
    if not repeated.isEmpty():
        once = repeated.groupBy("_key").agg(F.sum("_n").alias("_n"))
        spread = keyed_join(own.withColumn("_key", F.xxhash64(*alike)), once, ["_key"], "_n")
        own = spread.withColumn("virtual_slot", F.when(F.col("_n").isNull(), F.col("virtual_slot")).otherwise(slot("doc_id", "text_crc32", "row_id")))
    return own.select("doc_id", "size", "text_crc32", "virtual_slot")


def slot_stats(sizes: DataFrame) -> DataFrame:
    """virtual_slot, bytes, records: one row per slot in use."""
    return sizes.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))


def _largest_first(slots: Column, loads: Column) -> Column:
    """Give each slot (largest first) to the shard with the least bytes so far."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("put"))

    def step(state: Column, slot: Column) -> Column:
        to = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        grown = F.transform(state["loads"], lambda x, i: F.when(i == to, x + slot["bytes"]).otherwise(x))
        return F.struct(grown.alias("loads"), F.concat(state["put"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("shard")))).alias("put"))

    return F.aggregate(slots, start, step, lambda s: s["put"])


def _sorted_slots(stats: DataFrame) -> Column:
    return F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), asc=False)


def build_map(stats: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: version, virtual_slot, shard. Ties go to the larger slot number first."""
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    one = stats.agg(_sorted_slots(stats).alias("slots"))
    return one.select(F.explode(_largest_first(F.col("slots"), loads)).alias("m")).select(F.lit(1).alias("version"), "m.virtual_slot", "m.shard")


def rebalance(slot_map: DataFrame, stats: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version of the map: slots stay unless their shard is gone or over its share.

    Within a shard slots are kept, largest first, while they fit the mean load plus
    ``tolerance``; the rest, and slots the map lacks, go to the least loaded shards.
    """
    version = slot_map.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    total = stats.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    current = stats.join(slot_map.select("virtual_slot", "shard"), "virtual_slot", "left").where("records > 0")
    upto = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    placed = current.withColumn("upto", F.sum("bytes").over(upto)).join(F.broadcast(total))
    fits = (F.col("shard") < shards) & (F.col("upto") <= F.col("total") / shards * (1 + tolerance))
    placed = placed.withColumn("stays", F.coalesce(fits, F.lit(False)))
    kept = placed.groupBy().agg(F.collect_list(F.when(F.col("stays"), F.struct("virtual_slot", F.col("shard").cast("int").alias("shard"), "bytes"))).alias("kept"), F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "virtual_slot"))), asc=False).alias("pool"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.filter("kept", lambda k: k["shard"] == s), F.lit(0).cast("long"), lambda a, k: a + k["bytes"]))
    put = F.concat(F.transform("kept", lambda k: F.struct(k["virtual_slot"].alias("virtual_slot"), k["shard"].alias("shard"))), _largest_first(F.col("pool"), loads))
    return kept.select(F.explode(put).alias("m")).join(F.broadcast(version)).select("version", "m.virtual_slot", "m.shard")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Store one version of the map in the table at ``path``; older versions stay readable, and a version is never written twice."""
    row = slot_map.agg(F.min("version").alias("low"), F.max("version").alias("high")).first()
    if row["low"] is not None:
        if row["low"] != row["high"]:
            raise ValueError("one version at a time")
        slot_map.select("virtual_slot", "shard").write.mode("errorifexists").parquet(f"{path}/version={row['low']}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the latest by default."""
    stored = spark.read.option("basePath", path).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select("version", "virtual_slot", "shard")


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a map is stored at ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def current_map(stats: DataFrame, path: str, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The latest stored map, brought up to date with ``stats``.

    Where none is stored, version 1 is made. A stored one is edited, as a new version, only if a slot in use
    has no shard or a shard that is gone, or a shard is over its share by more than ``tolerance``.
    """
    spark = stats.sparkSession
    if not stored(spark, path):
        made = build_map(stats, shards)
        if made.isEmpty():
            return made
        save_map(made, path)
        return load_map(spark, path)
    latest = load_map(spark, path)
    loads = stats.join(latest, "virtual_slot", "left").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    over = F.col("shard").isNull() | (F.col("shard") >= shards) | (F.col("bytes") > F.sum("bytes").over(Window.partitionBy()) / shards * (1 + tolerance))  # a row per shard
    if not loads.where("bytes > 0").select(over.alias("over")).where("over").isEmpty() or latest.select("shard").distinct().count() < shards:
        save_map(rebalance(latest, stats, shards, tolerance), path)
        latest = load_map(spark, path)
    return latest


def assign(sizes: DataFrame, slot_map: DataFrame, stats: DataFrame) -> DataFrame:
    """Every record with its shard and its gapless place there.

    Places are ranked within virtual slots and shifted by the slots before in the
    shard, so no task ever holds a whole shard. Repeated rows get places of their own.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_map.join(stats, "virtual_slot").withColumn("start", F.coalesce(F.sum("records").over(before), F.lit(0)))
    own = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    ranked = sizes.withColumn("own", F.row_number().over(own) - 1)
    return ranked.join(F.broadcast(placed.select("virtual_slot", "shard", "start", "version")), "virtual_slot").select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("own")).cast("long").alias("slot"), "virtual_slot", F.col("version").alias("map_version"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = VIRTUAL_SLOTS, path: str | None = None) -> DataFrame:
    """Shard ``docs`` under the law ``bytes``: shard sizes as equal as whole slots allow.

    Columns: doc_id, size, text_crc32, law, shard, slot (place in the shard),
    grown_shard (null under this law), virtual_slot, map_version. Null and empty texts
    weigh ``OVERHEAD``; an empty table gives no rows; other columns are ignored. The slot map
    is stored at ``path`` (by default a new one in the shared folder) and read from there; one that is
    there already is edited where it no longer balances.
    """
    sizes = materialise(record_sizes(docs, slots), "slotted")
    stats = materialise(slot_stats(sizes), "slots")
    slot_map = current_map(stats, path or new_table(docs.sparkSession, "slot-map"), shards)
    return assign(sizes, slot_map, stats).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
