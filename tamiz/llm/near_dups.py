"""N-gram Jaccard join by MinHash banding.

Texts become sets of word n-grams; documents with equal sets are one class from the
start. Class representatives are dealt by band hashes, band and row counts following from
the target recall at the threshold. Small buckets give candidate pairs, which are
made distinct and verified on the full n-gram sets. Large buckets never
give pairs as rows: those that overlap form clusters, a cluster is cut into blocks by
set size and hash, and every two blocks that can hold a link are verified in one
task, which returns sums of links and a spanning forest only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import id_in, id_out, keyed_join, materialise, sized
from tamiz.llm.components import components

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Chance to share a bucket that is tolerated at this low similarity.
FALSE_AT, FALSE_RATE = 0.3, 0.1
#: Buckets above this size go by blocks of about so many representatives, and of about so many n-grams.
SMALL_BUCKET = 16
BLOCK, BLOCK_GRAMS = 1024, 1 << 20
CACHED_WORDS = 400_000
CHUNK = 4096
CELLS = 4_000_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, false_at: float = FALSE_AT, false_rate: float = FALSE_RATE) -> tuple[int, int]:
    """Bands and rows with the fewest hashes that find a pair at ``threshold`` with ``recall`` and one at ``false_at`` with less than ``false_rate``."""
    found = []
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if 1 - (1 - false_at**rows) ** bands <= false_rate:
            found.append((bands * rows, bands, rows))
    return min(found)[1:]


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


class Shingler:
    """64-bit hashes of a text's distinct n-grams, sorted. Words are split at white space and lower-cased.

    A text of fewer words than ``ngram`` has one n-gram, all its words; one without words none.
    """

    def __init__(self, ngram: int = NGRAM) -> None:
        self.ngram = ngram
        self.words: dict[str, int] = {}
        self.factors = _mix(np.arange(1, ngram + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)

    def _hashes(self, words: list[str]) -> np.ndarray:
        known = self.words
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h, k = self._hashes(words), min(self.ngram, len(words))
        n = len(h) - k + 1
        with np.errstate(over="ignore"):
            mixed = np.full(n, k, np.uint64)
            for i in range(k):
                mixed += h[i : i + n] * self.factors[i]
        return np.unique(_mix(mixed))


class MinHasher:
    """Band hashes of a set: ``bands`` values, each from the least hashes of ``rows`` permutations."""

    def __init__(self, bands: int, rows: int) -> None:
        self.bands, self.rows = bands, rows
        seeds = np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        self.scale, self.shift = _mix(seeds[: bands * rows]) | np.uint64(1), _mix(seeds[bands * rows :])
        self.weights = _mix(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(len(self.scale), ~np.uint64(0))
        with np.errstate(over="ignore"):
            for start in range(0, len(grams), CHUNK):
                part = grams[start : start + CHUNK]
                low = np.minimum(low, (self.scale[:, None] * part + self.shift[:, None]).min(axis=1))
            keys = (_mix(low).reshape(self.bands, self.rows) * self.weights).sum(axis=1, dtype=np.uint64)
            return _mix(keys + np.arange(self.bands, dtype=np.uint64))


def signatures(docs: DataFrame, ngram: int, bands: int, rows: int) -> DataFrame:
    """row_id, doc_id (null as NULL_ID), text_hash, grams, set_digest (null without words), bands."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, minhash = Shingler(ngram), MinHasher(bands, rows)
        for pdf in frames:
            digests, counts, keys = [], [], []
            for text in pdf.pop("text"):
                grams = shingle(text)
                counts.append(len(grams))
                digests.append(blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                keys.append(minhash(grams).astype(np.int64) if len(grams) else np.zeros(0, np.int64))
            yield pdf.assign(grams=counts, set_digest=digests, bands=keys)

    text = docs["text"].cast("string")
    read = docs.select(F.monotonically_increasing_id().alias("row_id"), id_in(docs["doc_id"]).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return read.mapInPandas(batches, "row_id long, doc_id long, text_hash long, grams long, set_digest binary, bands array<long>")


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` with ``shared`` members in common reach ``threshold``."""
    return shared >= threshold * (a + b - shared) - 1e-9


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets; members of one set only are left out first."""
    sets = [*left, *right]
    members, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = times[at] > 1
    column = np.cumsum(times > 1)[at[keep]] - 1
    owner, n = owner[keep], int((times > 1).sum())
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out, step = np.zeros((len(left), len(right)), np.float32), max(1, CELLS // len(sets))
    for start in range(0, n, step):
        lo, hi = np.searchsorted(column, [start, start + step])
        has = np.zeros((len(sets), min(step, n - start)), np.float32)
        has[owner[lo:hi], column[lo:hi] - start] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def forest(pairs: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``pairs`` (index pairs) connect, fewer than there are ids."""
    parent = np.arange(len(ids))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for x, y in pairs:
        a, b = root(x), root(y)
        if a != b:
            parent[a] = b
            edges.append((int(ids[x]), int(ids[y])))
    return edges


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the representatives in ``wanted`` (node, doc_id, text_hash)."""
    text = docs["text"].cast("string")
    own = docs.select(id_in(docs["doc_id"]).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return own.join(sized(wanted), ["doc_id", "text_hash"]).select("node", "text")


def _pair_links(pairs: DataFrame, texts: DataFrame, weights: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """The pairs (a, b) that reach the threshold, with both weights; each text moves once per pair at most."""

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, last, own = Shingler(ngram), None, None
        for pdf in frames:
            ok = []
            for a, text_a, text_b in zip(pdf["a"], pdf["text_a"], pdf["text_b"], strict=True):
                if a != last:
                    last, own = a, shingle(text_a)
                other = shingle(text_b)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                ok.append(bool(linked(shared, len(own), len(other), threshold)))
            yield pdf.loc[ok, ["a", "b"]]

    second = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    whole = second.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    good = whole.mapInPandas(verify, "a long, b long").distinct()
    return good.join(weights.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(weights.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")


def _block_links(members: DataFrame, texts: DataFrame, ngram: int, threshold: float, block: int) -> DataFrame:
    """kind, x, y of clusters (cluster, node, n, grams): for kind 0, node x has y links; for kind 1, x and y are connected.

    Sets whose sizes differ by a factor below the threshold cannot be linked, so blocks only
    meet blocks of their own and the next size class.
    """
    classed = members.withColumn("class", F.floor(F.log(F.col("grams").cast("double")) / F.lit(-math.log(threshold))).cast("int"))
    enough = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("grams") / F.lit(BLOCK_GRAMS)))
    sizes = classed.groupBy("cluster", "class").agg(enough.cast("int").alias("blocks"))
    upper = sizes.select("cluster", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
    lower = sizes.select("cluster", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below"))
    table = sizes.join(upper, ["cluster", "class"], "left").join(lower, ["cluster", "class"], "left").na.fill(0, ["above", "below"])
    # One row per cluster and class: where they are few, the members of a large cluster stay where they are.
    table = sized(materialise(table, "classes"))
    placed = classed.join(table, ["cluster", "class"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda j: j < n)
    unit = lambda step, i, j, side: F.struct(F.lit(step).alias("step"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    own = F.col("own")
    same = F.transform(upto(F.col("blocks")), lambda j: unit(0, F.least(own, j), F.greatest(own, j), (own > j).cast("int")))
    up = F.transform(upto(F.col("above")), lambda j: unit(1, own, j, F.lit(0)))
    down = F.transform(upto(F.col("below")), lambda j: unit(-1, j, own, F.lit(1)))
    dealt = placed.join(texts, "node").withColumn("u", F.explode(F.concat(same, up, down)))
    rows = dealt.select("cluster", F.when(F.col("u.step") < 0, F.col("class") - 1).otherwise(F.col("class")).alias("class"), F.abs("u.step").alias("step"), "u.i", "u.j", "u.side", "node", "n", "text")

    def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shingle = Shingler(ngram)
        pdf = pdf.drop_duplicates("node").sort_values(["side", "node"])
        alone = key[2] == 0 and key[3] == key[4]  # a block with itself
        ids, n = pdf["node"].to_numpy(), pdf["n"].to_numpy()
        sets, split = [shingle(t) for t in pdf["text"]], len(pdf) if alone else int((pdf["side"] == 0).sum())
        first, second = (slice(0, split), slice(0, split)) if alone else (slice(0, split), slice(split, len(pdf)))
        if not len(ids[first]) or not len(ids[second]):
            return pd.DataFrame({"kind": [], "x": [], "y": []}, dtype="int64")
        size = np.array([len(s) for s in sets], np.float64)
        ok = linked(overlaps(sets[first], sets[second]).astype(np.float64), size[first][:, None], size[second][None, :], threshold)
        if alone:
            np.fill_diagonal(ok, False)
        rows = [(0, int(x), int(c)) for x, c in zip(ids[first], ok @ n[second], strict=True) if c]
        if not alone:
            rows += [(0, int(x), int(c)) for x, c in zip(ids[second], ok.T @ n[first], strict=True) if c]
        pairs = np.argwhere(np.triu(ok) if alone else ok)
        pairs[:, 1] += second.start
        rows += [(1, x, y) for x, y in forest(pairs, ids)]
        return pd.DataFrame(rows, columns=["kind", "x", "y"], dtype="int64")

    return rows.groupBy("cluster", "class", "step", "i", "j").applyInPandas(verify, "kind long, x long, y long")


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, kept, n_grams, text_hash: one row per row of ``docs``.

    Two documents are linked if the Jaccard similarity of their n-gram sets reaches
    ``threshold``; n_links counts the documents linked to a row, copies included.
    class_id is the smallest doc_id of all that links connect, and of each
    such group the row with the largest doc_id is kept (null ids last; one of repeated rows). Texts
    without words have no links and stay, null ones too. Other columns are ignored.
    """
    bands, rows = choose_bands(threshold, recall)
    found = materialise(signatures(docs, ngram, bands, rows), "signatures")
    groups = found.where("set_digest is not null").groupBy("set_digest").agg(F.min("row_id").alias("node"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups, "classes")
    # representatives: narrow columns and the bands of one row per class
    reps = materialise(found.join(groups.select(F.col("node").alias("row_id"), "n"), "row_id").select(F.col("row_id").alias("node"), "n", "doc_id", "text_hash", "grams", "bands"), "representatives")
    keyed = reps.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).where("size > 1")
    dealt = materialise(keyed_join(keyed, materialise(buckets, "bucket-sizes"), ["key"], "size").where("size is not null"), "buckets")
    members = F.sort_array(F.collect_list("node"))
    small = dealt.where(F.col("size") <= SMALL_BUCKET).groupBy("key").agg(members.alias("m"))
    couple = F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, SMALL_BUCKET), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = small.select(F.explode(F.flatten(couple)).alias("p")).select("p.a", "p.b").distinct()
    clusters = materialise(components(dealt.where(F.col("size") > SMALL_BUCKET).select(F.col("node").alias("u"), F.col("first").alias("v"))), "clusters")
    inside = clusters.select(F.col("node").alias("a"), F.col("label").alias("c_a")), clusters.select(F.col("node").alias("b"), F.col("label").alias("c_b"))
    apart = pairs.join(inside[0], "a", "left").join(inside[1], "b", "left").where("c_a is null or c_b is null or c_a <> c_b").select("a", "b")
    apart = materialise(apart, "pairs")
    wanted = apart.select(F.col("a").alias("node")).union(apart.select("b")).union(clusters.select("node")).distinct()
    texts = materialise(_texts(docs, materialise(reps.join(wanted, "node").select("node", "doc_id", "text_hash"), "wanted")), "texts")
    links = materialise(_pair_links(apart, texts, reps.select("node", "n"), ngram, threshold), "links")
    crowded = reps.join(clusters.select("node", F.col("label").alias("cluster")), "node").select("cluster", "node", "n", "grams")
    blocks = materialise(_block_links(crowded, texts, ngram, threshold, BLOCK), "blocks")
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(blocks.where("kind = 1").select(F.col("x").alias("u"), F.col("y").alias("v")))
    label = components(edges)
    count = links.select(F.col("a").alias("node"), F.col("n_b").alias("c")).unionByName(links.select(F.col("b").alias("node"), F.col("n_a").alias("c"))).unionByName(blocks.where("kind = 0").select(F.col("x").alias("node"), F.col("y").alias("c")))
    links_of = count.groupBy("node").agg(F.sum("c").alias("others"))
    table = materialise(groups.join(label, "node", "left").join(links_of, "node", "left").select("set_digest", "n", F.coalesce("label", "node").alias("label"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")), "class-links")
    narrow = found.drop("bands")
    none = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in ("n", "label", "n_links")]
    known = keyed_join(narrow.where("set_digest is not null"), table, ["set_digest"], "n").unionByName(narrow.where("set_digest is null").select("*", *none))
    labelled = materialise(known.drop("n").withColumn("label", F.coalesce("label", "row_id")), "labelled")
    best = labelled.groupBy("label").agg(F.min(id_out(F.col("doc_id"))).alias("class_id"), F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("n"))
    return keyed_join(labelled, materialise(best, "best"), ["label"], "n").select(
        id_out(F.col("doc_id")).alias("doc_id"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("row_id") == F.col("keep.row_id")).alias("kept"), F.col("grams").alias("n_grams"), "text_hash"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    marked = materialise(near_duplicates(docs), "marked")
    kept = marked.where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_hash").alias("_kept_hash"))
    own = docs.select(F.struct("*").alias("_row"), docs["doc_id"].cast("long").alias("_id"), F.xxhash64(docs["text"].cast("string")).alias("_hash"))
    found = own.join(kept, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_hash") == F.col("_kept_hash")), "left_semi")
    if not marked.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():  # repeated rows match one key
        found = found.dropDuplicates(["_id", "_hash"])
    return found.select("_row.*")
