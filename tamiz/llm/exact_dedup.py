"""Exact dedup against immutable snapshots, screened by static binary-fuse filters.

A snapshot keeps one row per distinct digest, in buckets, and one filter per bucket
(nine to ten bits a digest). A new batch is first grouped by itself; its distinct
digests go through the filters of their buckets. Only positives meet the snapshot's
exact rows, where the texts themselves are compared.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.common import keyed_join, materialise, sized

#: Digests that share one filter; bounds the work of a task whatever the snapshot's size.
KEYS_PER_FILTER = 4096
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTER_SCHEMA = "bucket long, seed long, segment long, segments long, fingerprints binary"


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (murmur style)."""
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots in consecutive segments for each hash."""
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """seed, segment length, segment count and fingerprints for distinct uint64 keys.

    Keys are peeled in rounds: all keys that are alone in some slot leave together,
    and slots are filled in the reverse order. A stuck seed gives way to the next.
    """
    keys = np.unique(keys)
    n = len(keys)
    segment = 4 if n < 2 else max(4, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
    factor = 2.0 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    segments = max(1, math.ceil(round(n * factor) / segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1, 1000):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        at = _places(h, segment, segments)
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, left = [], n
        while left:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                break
            who, index = np.unique(owner[alone], return_index=True)
            rounds.append((who, alone[index]))
            for row in at:
                np.subtract.at(count, row[who], 1)
                np.bitwise_xor.at(owner, row[who], who)
            left -= len(who)
        if left:
            continue
        table, prints = np.zeros(size, np.uint8), _prints(h)
        for who, slot in reversed(rounds):
            table[slot] = 0
            table[slot] = prints[who] ^ table[at[0][who]] ^ table[at[1][who]] ^ table[at[2][who]]
        return seed, segment, segments, table.tobytes()
    raise RuntimeError("no seed gives a filter for these keys")


def probe_filter(keys: np.ndarray, seed: int, segment: int, segments: int, fingerprints: bytes) -> np.ndarray:
    """Which keys may be in the set: all members, and about one other in 256."""
    h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    table = np.frombuffer(fingerprints, np.uint8)
    at = _places(h, segment, segments)
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == _prints(h)


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[:8] for d in digests), "<u8").astype(np.uint64)


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, 9, 4)), 16, 10).cast("long"), F.lit(buckets))


class Snapshot(NamedTuple):
    """An immutable set of texts: exact rows (digest, n, keep), one filter per bucket, and the number of buckets."""

    exact: DataFrame
    filters: DataFrame
    buckets: int


def digests(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text_hash (of the text as it is), digest (of the normalised text), row_id of every row; written once."""
    text = docs["text"].cast("string")
    digest = F.unhex(F.sha2(normalised(text), 256))
    return materialise(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), digest.alias("digest"), F.monotonically_increasing_id().alias("row_id"), *more), "digests")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: n, and keep = the largest (doc_id, row_id, text_hash). Partial sums absorb hot groups."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row_id", "text_hash")).alias("keep"))


def build_snapshot(rows: DataFrame, keys_per_filter: int = KEYS_PER_FILTER) -> Snapshot:
    """The snapshot of ``rows`` (see ``digests``)."""
    exact = materialise(grouped(rows), "exact")
    buckets = max(1, math.ceil(exact.count() / keys_per_filter))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *build_filter(_keys(pdf["digest"])))], columns=["bucket", "seed", "segment", "segments", "fingerprints"])

    filters = exact.select(_bucket(F.col("digest"), buckets).alias("bucket"), "digest").groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)
    return Snapshot(exact, materialise(filters, "filters"), buckets)


def save_snapshot(snapshot: Snapshot, path: str) -> None:
    """Write a snapshot for later batches; an existing one is never overwritten."""
    snapshot.exact.write.parquet(f"{path}/exact")
    snapshot.filters.write.parquet(f"{path}/filters")
    snapshot.exact.sparkSession.range(1).select(F.lit(snapshot.buckets).cast("long").alias("buckets")).write.parquet(f"{path}/layout")


def load_snapshot(spark: SparkSession, path: str) -> Snapshot:
    return Snapshot(spark.read.parquet(f"{path}/exact"), spark.read.parquet(f"{path}/filters"), spark.read.parquet(f"{path}/layout").first()["buckets"])


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests of ``incoming`` (distinct) that the snapshot may hold."""

    def probe(_: tuple, new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if new.empty or held.empty:
            return new.iloc[:0][["digest"]]
        f = held.iloc[0]
        return new.loc[probe_filter(_keys(new["digest"]), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["fingerprints"]), ["digest"]]

    new = incoming.select(_bucket(F.col("digest"), buckets).alias("bucket"), "digest")
    return new.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest binary")


def _texts(docs: DataFrame, wanted: DataFrame, rows: int, name: str) -> DataFrame:
    """digest and text of the rows in ``wanted`` (digest, and the doc_id and text_hash of one row): the one place where texts move.

    Rows are found by id and hash together, so rows that share a null or repeated id do not meet each other's digests.
    """
    small = sized(wanted.select("digest", F.struct("at.doc_id", "at.text_hash").alias("_at")), rows)
    raw = docs["text"].cast("string")
    own = docs.select(F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(raw).alias("text_hash")).alias("_own"), raw.alias("raw"))
    text = normalised(F.col("raw"))
    own_text = F.when(F.unhex(F.sha2(text, 256)) == F.col("digest"), text)  # a filter here would become a join key, worked out for every row
    found = own.join(small, F.col("_own").eqNullSafe(F.col("_at"))).select("digest", own_text.alias("text"))
    return found.groupBy("digest").agg(F.min("text").alias(name), F.max("text").alias(f"{name}_other"))


def confirmed(incoming: DataFrame, snapshot: Snapshot, docs: DataFrame, snapshot_docs: DataFrame) -> DataFrame:
    """digest, n, keep, new_n, new_keep of the digests of ``incoming`` (see ``grouped``) whose text is in the snapshot byte by byte."""
    positive = screen(incoming, snapshot.filters, snapshot.buckets)
    new = incoming.select("digest", F.col("n").alias("new_n"), F.col("keep").alias("new_keep"))
    met = materialise(positive.join(snapshot.exact, "digest").join(new, "digest"), "met")
    n = met.count()
    old_text = _texts(snapshot_docs, met.select("digest", F.col("keep").alias("at")), n, "old_text")
    new_text = _texts(docs, met.select("digest", F.col("new_keep").alias("at")), n, "new_text")
    same = old_text.join(new_text, "digest").where("old_text = new_text and old_text_other = old_text and new_text_other = new_text").select("digest")
    return materialise(met.join(same, "digest"), "verified")


def mark_duplicates(docs: DataFrame, in_snapshot: Column, keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``in_snapshot`` tells the rows of the immutable snapshot from the new batch. Of equal
    texts the row with the largest doc_id stays, null ids last; of repeated rows with
    one doc_id exactly one stays (any; they are alike). Null text equals empty text. An
    empty snapshot, batch or table is fine; other columns of ``docs`` are ignored.
    """
    rows = digests(docs, F.coalesce(in_snapshot, F.lit(True)).alias("old"))
    snapshot = build_snapshot(rows.where("old"), keys_per_filter)
    incoming = materialise(grouped(rows.where("not old")), "incoming")
    verified = confirmed(incoming, snapshot, docs, docs)
    sides = []
    for frame, old, other in ((snapshot.exact, True, "new_"), (incoming, False, "")):
        more = verified.select("digest", F.col(f"{other}n").alias("other_n"), F.col(f"{other}keep").alias("other_keep"))
        both = F.greatest(F.struct("keep.doc_id", "keep.row_id"), F.struct("other_keep.doc_id", "other_keep.row_id"))
        keep = F.when(F.col("other_keep").isNull(), F.struct("keep.doc_id", "keep.row_id")).otherwise(both)
        sides.append(frame.join(more, "digest", "left").select("digest", F.lit(old).alias("old"), "n", (F.col("n") + F.coalesce("other_n", F.lit(0))).alias("group_size"), keep.alias("keep")))
    groups = sides[0].unionByName(sides[1])
    return keyed_join(rows, materialise(groups, "groups"), ["digest", "old"], "n").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("row_id") == F.col("keep.row_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def mark_batch(batch: DataFrame, snapshot: Snapshot, snapshot_docs: DataFrame) -> DataFrame:
    """One row per row of a later ``batch``: doc_id, known, keep_id, group_size, kept, text_sha256.

    ``known`` texts are in the snapshot (of ``snapshot_docs``), which keeps its row: none of the batch stays.
    Of others the row of the batch with the largest doc_id stays. Null text equals empty text.
    """
    rows = digests(batch)
    incoming = materialise(grouped(rows), "incoming")
    verified = confirmed(incoming, snapshot, batch, snapshot_docs).select("digest", F.col("n").alias("old_n"), F.col("keep").alias("old_keep"))
    groups = materialise(incoming.join(verified, "digest", "left"), "groups")
    known = F.col("old_keep").isNotNull()
    return keyed_join(rows, groups, ["digest"], "n").select(
        "doc_id", known.alias("known"), F.when(known, F.col("old_keep.doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), (F.col("n") + F.coalesce("old_n", F.lit(0))).cast("long").alias("group_size"),
        (~known & (F.col("row_id") == F.col("keep.row_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def half_by_id(docs: DataFrame) -> Column:
    """The split of a single table that the query uses: half the ids, by checksum, form the snapshot."""
    return F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(2)) == 0


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one of each group of equal texts."""
    marked = materialise(mark_duplicates(docs, half_by_id(docs)), "marked")
    kept = marked.where("kept").select(F.col("doc_id").alias("_keep"), F.unhex("text_sha256").alias("_sha"))
    own = docs.select(F.struct("*").alias("_row"), docs["doc_id"].cast("long").alias("_id"), F.unhex(F.sha2(normalised(docs["text"]), 256)).alias("_digest"))
    found = own.join(kept, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_digest") == F.col("_sha")), "left_semi")
    repeats = marked.where("doc_id <=> keep_id").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not repeats.isEmpty():  # rows that repeat an id and a text match one key; keep one of them
        found = found.dropDuplicates(["_id", "_digest"])
    return found.select("_row.*")
