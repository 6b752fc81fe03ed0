"""Mixing, top-k search and the pipeline against plain versions."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tamiz.llm import mixing, near_dups, topk


def sizes(rows):
    return [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, _, s in rows]


def targets(rows):
    """Water-filling of all words by weight, in plain Python."""
    total = defaultdict(int)
    for _, n, s in sizes(rows):
        total[s] += n
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight, capped = {s: i % 3 + 1 for i, s in enumerate(order)}, set()
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        share = (sum(total.values()) - 3 * sum(total[s] for s in capped)) / free if free else 0
        over = {s for s in order if s not in capped and weight[s] * share > 3 * total[s]}
        if not over:
            return total, {s: 3.0 * total[s] if s in capped else weight[s] * share for s in order}
        capped |= over


def mixed_rows():
    rng = random.Random(13)
    rows = [(i, "w " * int(rng.expovariate(0.02)), "en", rng.choice(["a", "a", "a", "b", "c", "Z", None])) for i in range(600)]
    return rows + [(700, "tiny one", "en", "tiny"), (701, None, "en", "empty"), (3, rows[3][1], "en", rows[3][3]), (None, "x y z", "en", "b")]


def test_mix(docs):
    rows = mixed_rows()
    got = mixing.mix(docs(rows)).collect()
    total, goal = targets(rows)
    assert Counter((r["doc_id"], r["size"], r["key"]) for r in got) == Counter((i, n, "null" if s is None else f"={s}") for i, n, s in sizes(rows))
    taken, by = defaultdict(int), defaultdict(list)
    for r in got:
        s = None if r["key"] == "null" else r["key"][1:]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(goal[s])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
        by[s].append(r)
    least = {s: min((r["size"] for r in rs if r["size"]), default=0) for s, rs in by.items()}
    assert all(abs(taken[s] - goal[s]) <= max(3 * least[s], 3) for s in goal)
    again = mixing.mix(docs(rows).repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in again)


def test_tilts_solve_the_dual(docs):
    rows = mixed_rows()
    counts = mixing.sized_documents(docs(rows)).groupBy("key", "source", "size").count().withColumnRenamed("count", "n").cache()
    goal = mixing.source_targets(counts)
    tilts = {r["key"]: (r["mean"], r["tilt"]) for r in mixing.solve(counts, goal).collect()}
    for r in goal.where("target > 0").collect():
        mean, tilt = tilts[r["key"]]
        got = sum(c["n"] * c["size"] * min(3.0, math.exp(min(tilt * c["size"] / mean, 2))) for c in counts.where("size > 0").collect() if c["key"] == r["key"])
        assert got == pytest.approx(r["target"], rel=1e-6)


def test_mix_of_nothing(docs):
    assert mixing.mix(docs([])).count() == 0
    assert [(r["size"], r["taken"]) for r in mixing.mix(docs([(1, None), (2, "")])).collect()] == [(0, 0), (0, 0)]


def test_resample_takes_what_the_mix_says(docs):
    rows = mixed_rows()
    frame = docs(rows)
    expected = Counter()
    for r in mixing.mix(frame).collect():
        expected[r["doc_id"]] += r["copies"]
    got = mixing.resample(frame)
    assert got.columns == frame.columns and Counter(r["doc_id"] for r in got.collect()) == +expected


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "'s' as shard", "0 as label")


def expected_top(rows, k=10):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in ok if i % 100 == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("stride", [7, 1024])
def test_top_k(spark, monkeypatch, stride):
    monkeypatch.setattr(topk, "STRIDE", stride)
    rng = np.random.default_rng(14)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(320)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (401, rows[0][1]), (500, [0.0] * 16), (501, None), (502, [None] + [0.1] * 15), (503, [math.inf] + [0.1] * 15), (504, [math.nan] + [0.1] * 15), (None, [0.1] * 16), (505, [0.5] * 4), (600, [-0.9] * 16)]
    got = topk.top_k(vectors(spark, rows), shard_rows=64, block_queries=2)
    assert sorted(tuple(r) for r in got.collect()) == expected_top(rows)


def test_top_k_of_few(spark):
    assert topk.top_k(vectors(spark, [])).count() == 0
    rows = [(0, [0.1, 0.2]), (1, [0.3, 0.1])]
    assert [tuple(r) for r in topk.top_k(vectors(spark, rows)).collect()] == expected_top(rows)
    assert topk.top_k(vectors(spark, rows[:1])).count() == 0


def test_maxscore_equals_brute_force():
    rng = np.random.default_rng(15)
    for _ in range(60):
        n, width = rng.integers(1, 300), rng.integers(1, 20)
        x = rng.integers(-50, 50, (n, width)) * (rng.random((n, width)) < 0.5)
        q, ids = rng.integers(-50, 50, width), rng.permutation(1000)[:n]
        ids_got, scores = topk.maxscore(np.ascontiguousarray(x.T), ids, q, -1, 5)
        assert list(zip(scores, ids_got)) == sorted(zip(x @ q, ids), key=lambda p: (-p[0], p[1]))[:5]


def test_pipeline_stages(spark, docs, tmp_path):
    rng = random.Random(16)
    voice = "the of and to in is that it was for with as this by from".split()
    rows = [(i, " ".join(rng.choice(voice) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randint(30, 90))), "en", rng.choice("abc")) for i in range(60)]
    rows += [(100, rows[0][1].upper(), "en", "a"), (101, rows[1][1], "en", "b"), (102, rows[2][1] + " coda", "en", "c"), (103, None, "en", "a"), (104, "", None, None), (105, "12 !!", "en", "b")]
    frame = docs(rows, extra=False)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    now, kept = frame, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = Counter(r["doc_id"] for r in now.collect())
    assert set(kept["language_id"]) == {r[0] for r in rows} - {103, 104, 105}
    assert set(kept["exact_dedup"]) == set(kept["language_id"]) - {0, 1}
    shingle = near_dups.Shingler()
    sets = {i: set(shingle(t).tolist()) for i, t, *_ in rows if i in kept["exact_dedup"]}
    near = {min(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near == {2} and set(kept["ngram_jaccard"]) == set(kept["exact_dedup"]) - near
    left = [r for r in rows if r[0] in kept["ngram_jaccard"]]
    _, goal = targets(left)
    words = {i: n for i, n, _ in sizes(left)}
    for s, t in goal.items():
        taken = sum(kept["mixing"][i] * words[i] for i, _, _, own in left if own == s)
        assert abs(taken - t) <= max(words.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == kept["mixing"]


def test_stages_on_odd_and_empty_tables(spark, docs, odd_rows):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (odd_rows, []):
            frame = docs(rows)
            out = stage(spark, frame, "")
            assert out.columns == frame.columns and out.count() <= 3 * len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs([]), "").count() == 0


def test_released_tables_are_gone(spark):
    from tamiz.llm import common

    other = common.materialise(spark.range(2), "other")
    before = common.made()
    first, last = common.materialise(spark.range(3), "first"), common.materialise(spark.range(4), "last")
    common.release(spark, keep=1, since=before)
    assert last.count() == 4 and other.count() == 2 and common.made() == before + 1
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        first.count()


def test_runs_release_their_own_tables_only(spark, tmp_path):
    from tamiz.llm import common, queries

    other = common.materialise(spark.range(2), "other")
    with common.own_tables():
        kept, gone = common.materialise(spark.range(3), "kept"), common.materialise(spark.range(4), "gone")
        common.release(spark, read_by=kept.where("id > 0"))
        assert kept.count() == 3 and common.made() == 1
        with pytest.raises(Exception, match=r"(?i)not.*exist"):
            gone.count()
    assert other.count() == 2
    spark.range(0, 40).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "'s' as source").write.parquet(str(tmp_path / "documents.parquet"))
    root = common.scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    found = queries.QUERIES["op4_sharding"](spark, str(tmp_path))
    assert found.count() == 40 and {x.rpartition("-")[0] for x in set(os.listdir(root)) - before} == {"slotted", "slots", "slot-map"}
    found = queries.QUERIES["op3_best_fit_packing"](spark, str(tmp_path))
    assert found.count() == 40


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://host"])
def test_a_cluster_needs_a_shared_folder(master):
    from tamiz.llm import common

    assert common.shared_folder("hdfs://x/y/", master) == "hdfs://x/y"
    with pytest.raises(ValueError, match="share"):
        common.shared_folder(None, master)
    assert common.shared_folder(None, "local[4]").startswith("file://")


def test_newton_steps_end_or_tell(docs):
    counts = mixing.sized_documents(docs([(i, "w " * (i % 9 + 1), "en", f"s{i % 4}") for i in range(200)])).groupBy("key", "source", "size").count().withColumnRenamed("count", "n").cache()
    goal = mixing.source_targets(counts)
    assert mixing.solve(counts, goal).count() == 4
    with pytest.raises(RuntimeError, match="not within"):
        mixing.solve(counts, goal, iterations=1)


def test_many_sources_keep_their_weights(docs):
    """Sources are ranked by code point, null last, over many ranges."""
    rows = [(i, "w " * 8, "en", None if i == 7 else f"{'é' if i % 3 else 'z'}{i:04d}") for i in range(700)]
    counts = mixing.sized_documents(docs(rows)).groupBy("key", "source", "size").count().withColumnRenamed("count", "n")
    by = {r["key"]: r["target"] for r in mixing.source_targets(counts).collect()}
    expected = targets(rows)[1]
    assert {k: pytest.approx(v) for k, v in by.items()} == {("null" if k is None else f"={k}"): v for k, v in expected.items()}


def test_top_k_beyond_exact_doubles(spark):
    """Components of any finite size: sums beyond 2^53 are exact, those beyond a long are given as its ends."""
    rows = [(0, [2.0**43, 1.0]), (100, [1.0, 2.0]), (1, [2.0**42, 3.0]), (2, [2.0**42, 2.0]), (3, [-(2.0**44), 0.0]), (4, [0.5, 0.25]), (5, [1e300, 0.0]), (6, [1e301, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    expected = []
    for q in (0, 100):
        scored = sorted((-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q)
        expected += [(q, i, clip(-s)) for s, i in scored]
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in topk.top_k(frame.coalesce(1)).orderBy("query_id", "rank").collect()]
    assert sorted(got) == sorted(expected)
    assert [r for r in got if abs(r[2]) < 2**63 - 1] == [r for r in expected if abs(r[2]) < 2**63 - 1]


def test_two_vectors_of_one_query_id(spark):
    rows = [(0, [0.1, 0.9]), (0, [0.9, 0.1]), (0, [0.9, 0.1]), *((i, [i / 50, 1 - i / 50]) for i in range(1, 30))]
    assert sorted(tuple(r) for r in topk.top_k(vectors(spark, rows)).collect()) == sorted(expected_top(rows))


def test_terms_are_pruned():
    """Products that the bounds save, counted; the result is that of all of them."""
    rng = np.random.default_rng(16)
    x = np.floor(rng.normal(0, 200, (20_000, 32)) * np.linspace(1, 0.05, 32))
    work = np.zeros(2, np.int64)
    q = x[7]
    ids, scores = topk.maxscore(np.ascontiguousarray(x.T), np.arange(len(x)), q, 7, 10, work=work)
    all_of_them = x @ q
    expected = sorted((i for i in range(len(x)) if i != 7), key=lambda i: (-all_of_them[i], i))[:10]
    assert ids.tolist() == expected and work[0] < 0.9 * work[1]
