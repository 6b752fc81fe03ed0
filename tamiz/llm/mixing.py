"""Mixing sources to target weights by entropy balancing.

Document rates are as close as possible (in relative entropy) to one each while the
words taken from every source meet its target. The convex dual has one variable
per source; its optimum tilts rates exponentially, ``rate = min(3, exp(lambda * size / mean))``.
Rates depend on source and size only, so documents are counted by both once, and every
Newton iteration is one grouped sum over that table. Rates are then rounded
into copies so that the words over or under carry to the next smaller size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.common import materialise, ordered_rank, salted_rank

MOST_COPIES = 3
SALTS = 64
#: Newton steps and bisections; a bracket closes long before. A run that needs more is an error.
ITERATIONS = 400
TOLERANCE = 1e-9
#: Words: maximal runs without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def weight_by_rank(rank: Column) -> Column:
    """1, 2, 3, repeating, by the rank of the source (from 0)."""
    return (rank % 3 + 1).cast("long")


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the source), source, size, tie of every row; null text has no words."""
    source = docs["source"].cast("string")
    text = docs["text"].cast("string")
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("key"), source.alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("tie")
    )


def source_targets(counts: DataFrame, weight: Callable[[Column], Column] = weight_by_rank, most: int = MOST_COPIES) -> DataFrame:
    """key, source_size, smallest (size over 0), documents, target of every source.

    Sources are ranked by code point, null last. Targets share all words by weight; one
    that exceeds ``most`` times its source's words stops there, and what it leaves is
    shared by the others, round by round. Only the sums of a round reach the driver.
    """
    by_source = counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("documents"))
    ranked = ordered_rank(by_source, F.col("source").asc_nulls_last()).withColumn("weight", weight(F.col("rank")))
    sources = materialise(ranked.select("key", "source_size", "smallest", "documents", "weight"), "sources")
    cap = F.col("source_size") * most
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, stopped = (0, 1), -1
    while True:
        over = F.col("weight") * float(share[0]) > cap * float(share[1])
        capped, weights, count = sources.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count(F.when(over, 1))).first()
        if count == stopped or not weights:
            break
        # weights of stopped sources stay out from now on: the share only grows
        stopped, share = count, (total - capped, weights)
    over = F.col("weight") * float(share[0]) > cap * float(share[1])
    free = F.col("weight") * F.lit(float(share[0])) / F.lit(float(share[1]))
    return sources.select("key", "source_size", "smallest", "documents", F.when(over, cap.cast("double")).otherwise(free).alias("target"))


def solve(counts: DataFrame, targets: DataFrame, most: int = MOST_COPIES, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """key, mean, tilt of every source that has words: safeguarded Newton steps on the dual, all sources at once.

    A step that leaves the bracket of its source is replaced by a bisection. Ends when each
    source is within ``tolerance`` of its target, or its bracket has closed to neighbouring numbers;
    if neither happens in ``iterations`` steps, an error is raised.
    """
    size = F.col("source_size").cast("double")
    log_share = F.log(F.col("target") / size)
    least = F.col("smallest") * F.col("documents") / size  # the smallest size over the mean one
    few = F.col("target") < size
    start = targets.where("target > 0").select(
        "key", "target", (size / F.col("documents")).alias("mean"),
        F.when(few, log_share / least).otherwise(0.0).alias("low"), F.when(few, 0.0).otherwise(math.log(most) / least).alias("high"), log_share.alias("guess"), F.lit(False).alias("done"),
    )
    state = materialise(start.select("key", "target", "mean", "low", "high", F.greatest("low", F.least("high", "guess")).alias("tilt"), "done"), "tilts")
    rows = counts.where("size > 0").select("key", "size", "n")
    for _ in range(iterations):
        x = F.col("size") / F.col("mean")
        bent = F.col("tilt") * x < math.log(most)
        rate = F.when(bent, F.exp(F.col("tilt") * x)).otherwise(float(most))
        words = F.col("size") * F.col("n")
        sums = rows.join(state, "key").groupBy("key").agg(F.sum(words * rate).alias("got"), F.sum(F.when(bent, words * rate * x)).alias("slope"), *[F.first(c).alias(c) for c in ("target", "mean", "low", "high", "tilt", "done")])
        miss = F.col("got") - F.col("target")
        near = sums.withColumn("low", F.when(miss <= 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(miss >= 0, F.col("tilt")).otherwise(F.col("high")))
        step = F.col("tilt") - miss / F.col("slope")
        middle = (F.col("low") + F.col("high")) / 2
        inside = (F.coalesce(F.col("slope"), F.lit(0.0)) > 0) & (step > F.col("low")) & (step < F.col("high"))
        done = F.col("done") | (F.abs(miss) <= tolerance * F.col("target")) | (F.col("high") - F.col("low") <= 4e-16 * F.greatest(F.abs("low"), F.abs("high")))
        moved = near.withColumn("done", done).withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(inside, step).otherwise(middle))
        state = materialise(moved.select("key", "target", "mean", "low", "high", "tilt", "done"), "tilts")
        if state.where("not done").isEmpty():
            break
    else:
        raise RuntimeError(f"after {iterations} iterations {state.where('not done').count()} sources are not within {tolerance} of their targets")
    return state.select("key", "mean", "tilt")


def round_copies(counts: DataFrame, targets: DataFrame, tilts: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """key, size, source_size, target, copies (of all documents of that size together), n.

    Within a source, from the largest size down, the copies of a size are those its rates
    ask for plus what rounding left so far, so the source ends within about half its
    smallest document of the target.
    """
    joined = counts.select("key", "size", "n").join(targets.select("key", "source_size", "target"), "key").join(tilts, "key", "left")

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        mean, tilt, carry, copies = pdf["mean"].iloc[0], pdf["tilt"].iloc[0], 0.0, []
        for size, n in zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True):
            if not size or tilt != tilt:  # no words, or a source without a target
                copies.append(0)
                continue
            power = tilt * size / mean
            carry += n * size * (math.exp(power) if power < math.log(most) else float(most))
            take = max(0, min(most * n, math.floor(carry / size + 0.5)))
            carry -= take * size
            copies.append(take)
        return pdf.assign(copies=copies)[["key", "size", "source_size", "target", "copies", "n"]]

    return joined.groupBy("key").applyInPandas(spread, "key string, size long, source_size long, target double, copies long, n long")


def mix(docs: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, key, tie, size, source_size, target, copies, taken: one row per row of ``docs``.

    Of documents alike in source and size, those first in a hash order of their ids take
    one copy more where copies do not divide evenly, so reruns agree. Documents without
    words are taken 0 times. An empty table gives no rows; other columns are ignored.
    """
    rows = materialise(sized_documents(docs), "sizes")
    counts = materialise(rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    targets = materialise(source_targets(counts, most=most), "targets")
    plan = materialise(round_copies(counts, targets, solve(counts, targets, most), most), "copies")
    order = [F.xxhash64("doc_id", "tie"), F.col("doc_id"), F.col("tie")]
    ranked = salted_rank(rows.select("doc_id", "key", "size", "tie"), ["key", "size"], order, F.xxhash64("tie", "doc_id"), SALTS, also=plan)
    each = F.floor(F.col("copies") / F.col("n"))
    own = (each + (F.col("rank") < F.col("copies") - each * F.col("n")).cast("long")).cast("long")
    return ranked.select("doc_id", "key", "tie", "size", "source_size", "target", own.alias("copies"), (own * F.col("size")).alias("taken"))


def resample(docs: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns, as often as it is taken."""
    taken = materialise(mix(docs, most).groupBy("doc_id", "key", "tie").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike")).where("copies > 0"), "taken")
    source = docs["source"].cast("string")
    own = docs.select(F.struct("*").alias("_row"), docs["doc_id"].cast("long").alias("_id"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("_key"), F.xxhash64(docs["text"].cast("string")).alias("_tie"))
    found = own.join(taken, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key")) & (F.col("_tie") == F.col("tie")))
    if not taken.where("alike > 1").isEmpty():  # repeated rows share what was given to them together
        place = F.row_number().over(Window.partitionBy("_id", "_key", "_tie").orderBy(F.lit(1))) - 1
        share = F.floor(F.col("copies") / F.col("alike"))
        found = found.withColumn("copies", share + (place < F.col("copies") - share * F.col("alike")).cast("long")).where("copies > 0")
    return found.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
