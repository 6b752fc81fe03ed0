"""Exact dedup, sharding and packing against brute force and round trips."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamiz.llm import exact_dedup, packing, sharding

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans(exact_dedup.UPPER, exact_dedup.UPPER.lower())


def norm(t):
    return (t or "").translate(LOWER)


def test_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 20_000):
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        made = exact_dedup.build_filter(keys)
        assert exact_dedup.probe_filter(keys, *made).all()
        others = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
        assert exact_dedup.probe_filter(others, *made).mean() < 0.02 or n < 3
        assert n < 20_000 or len(made[3]) < 1.25 * n


def check_dedup(rows, frame):
    got = exact_dedup.mark_duplicates(frame, exact_dedup.half_by_id(frame), keys_per_filter=3).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    expected = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            expected[(i, max(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) <= {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup(docs, odd_rows):
    check_dedup(odd_rows, docs(odd_rows))
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "A", "b", "ß", "É", "é", "c" * 50]) + str(rng.randrange(4))) for i in range(120)]
    check_dedup(rows, docs(rows))
    check_dedup([], docs([]))


def test_drop_duplicates_keeps_columns(docs, odd_rows):
    frame = docs(odd_rows)
    got = exact_dedup.drop_duplicates(frame)
    assert got.columns == frame.columns
    assert sorted(norm(r["text"]) for r in got.collect()) == sorted({norm(t) for _, t, *_ in odd_rows})


def test_sharding(docs, odd_rows):
    rows = odd_rows + [(100 + i, "x" * (i * 7 % 400)) for i in range(400)]
    got = sharding.shard_documents(docs(rows), shards=5, slots=64).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(5))
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.shard_documents(docs([])).count() == 0


def test_shards_are_balanced(docs):
    got = sharding.shard_documents(docs([(i, "x" * (i * 37 % 900)) for i in range(3000)]), shards=8)
    sizes = [r[0] for r in got.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 900


def test_rebalancing_edits_the_map(spark, docs, tmp_path):
    stats = sharding.slot_stats(sharding.record_sizes(docs([(i, "x" * (i * 37 % 900)) for i in range(2000)]), 128)).cache()
    first = sharding.build_map(stats, 4).cache()
    second = sharding.rebalance(first, stats, 5).cache()
    old, new = ({r["virtual_slot"]: r["shard"] for r in m.collect()} for m in (first, second))
    assert set(old) == set(new) and {r["version"] for r in second.collect()} == {2}
    moved = [s for s in old if old[s] != new[s]]
    assert set(new.values()) == set(range(5)) and len(moved) < 0.35 * len(old)
    loads = Counter()
    for r in stats.collect():
        loads[new[r["virtual_slot"]]] += r["bytes"]
    assert max(loads.values()) < 1.2 * min(loads.values())
    sharding.save_map(first, str(tmp_path / "map"))
    sharding.save_map(second, str(tmp_path / "map"))
    load = lambda v=None: {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path / "map"), v).collect()}
    assert load() == new and load(1) == old


def placed(counts, size):
    plan = packing.plan_counts(dict(counts), size)
    runs, bins = sorted(plan.runs), defaultdict(list)
    for i, (length, rank, first, offset) in enumerate(runs):
        end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[length]
        for k in range(end - rank):
            bins[first + k].append((offset, length))
    assert len(bins) == plan.bins and Counter(x for b in bins.values() for _, x in b) == Counter({k: v for k, v in counts.items() if v})
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    return plan.bins


def fewest(items, size):
    best, bins = [len(items)], []

    def go(i):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= items[i] and bins[k] not in bins[:k]:
                bins[k] -= items[i]
                go(i + 1)
                bins[k] += items[i]
        bins.append(size - items[i])
        go(i + 1)
        bins.pop()

    items.sort(reverse=True)
    go(0)
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(4)
    for _ in range(150):
        size = rng.choice([10, 20, 50])
        items = [rng.randint(1, size) for _ in range(rng.randint(0, 9))]
        plan, left = packing.Plan(), dict(Counter(items))
        packing.reduce_instance(left, plan, size)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert plan.bins + (fewest(rest, size) if rest else 0) == (fewest(items, size) if items else 0)
        assert placed(Counter(items), size) <= (fewest(items, size) if items else 0) + 1


def test_packing(docs, odd_rows):
    rows = odd_rows + [(20 + i, f"wort {i} " * (i * 3)) for i in range(60)] + [(99, "ά café ́ Σ\x1cb <|endoftext|>x")]
    got = packing.pack(docs(rows), TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        for piece, start in enumerate(range(0, len(ids) // 4, 2048)):
            part = ids[4 * start : 4 * (start + 2048)]
            expected[(i, piece, start, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter(tuple(r[:5]) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack(docs([]), TOKENIZER).count() == 0


@pytest.mark.parametrize("text", ["", "a", "It's 12 o'clock", "ÀÉÎ œuvre ŁÓDŹ", "漢字 кот 🙂", "x" * 3000])
def test_word_ids_equal_the_tokenizers(text):
    whole = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert packing.WordIds(TOKENIZER).encode([text]) == [np.array(whole, "<u4").tobytes()]


def test_word_ids_of_every_code_point_below_u3000():
    words = packing.WordIds(TOKENIZER)
    texts = [f"{a}{chr(c)}{b}" for c in range(0x3000) for a, b in (("a", "b"), (" don't", ".")) if not 0xD800 <= c < 0xE000]
    expected = [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert words.encode(texts) == expected


def test_a_kept_snapshot_screens_later_batches(docs, spark, tmp_path):
    old = [(i, f"text {i}") for i in range(50)] + [(60, None), (61, "Text 7")]
    first = docs(old)
    snapshot = exact_dedup.build_snapshot(exact_dedup.digests(first), keys_per_filter=8)
    exact_dedup.save_snapshot(snapshot, str(tmp_path / "snapshot"))
    held = exact_dedup.load_snapshot(spark, str(tmp_path / "snapshot"))
    batch = docs([(100, "TEXT 7"), (101, "new"), (102, "NEW"), (103, ""), (None, "new"), (104, "other")])
    got = {r["doc_id"]: tuple(r)[1:5] for r in exact_dedup.mark_batch(batch, held, first).collect()}
    assert got == {100: (True, 61, 3, False), 101: (False, 102, 3, False), 102: (False, 102, 3, True), 103: (True, 60, 2, False), None: (False, 102, 3, False), 104: (False, 104, 1, True)}
    with pytest.raises(Exception, match="(?i)exists"):
        exact_dedup.save_snapshot(snapshot, str(tmp_path / "snapshot"))
    assert exact_dedup.mark_batch(docs([]), held, first).count() == 0
    empty = exact_dedup.build_snapshot(exact_dedup.digests(docs([])))
    assert {r["known"] for r in exact_dedup.mark_batch(batch, empty, docs([])).collect()} == {False}


def test_rows_of_one_id_do_not_meet_each_others_digests(docs, monkeypatch):
    """Many rows without an id: each text is looked up by its own hash."""
    rows = [(None, f"text {i % 40}") for i in range(400)] + [(i, f"text {i}") for i in range(40)]
    frame = docs(rows)
    met = []
    plain = exact_dedup._texts
    monkeypatch.setattr(exact_dedup, "_texts", lambda *a: met.append(plain(*a)) or met[-1])
    got = exact_dedup.mark_duplicates(frame, F.col("doc_id").isNull()).collect()
    assert all(r["group_size"] == 11 and r["keep_id"] == int(r["doc_id"] if r["doc_id"] is not None else r["keep_id"]) for r in got) and sum(r["kept"] for r in got) == 40
    assert [m.count() for m in met] == [40, 40]


def test_repeated_rows_spread_over_slots(docs):
    rows = [(None, None)] * 300 + [(7, "same")] * 200 + [(i, "x" * (i % 50)) for i in range(1000, 1100)]
    got = sharding.shard_documents(docs(rows), shards=4, slots=64).collect()
    assert len(got) == 600 and len({r["virtual_slot"] for r in got if r["doc_id"] is None}) > 30
    loads = [sum(r["size"] for r in got if r["shard"] == k) for k in range(4)]
    assert max(loads) - min(loads) <= 200
    for k in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_the_stored_map_is_edited_only_where_it_must(docs, spark, tmp_path):
    path, rows = str(tmp_path / "map"), [(i, "x" * (i * 37 % 900)) for i in range(2000)]
    at = lambda rows, shards=4: {r["doc_id"]: (r["shard"], r["map_version"]) for r in sharding.shard_documents(docs(rows), shards, 128, path).collect()}
    first, again = at(rows), at(rows)
    assert first == again and {v for _, v in first.values()} == {1}
    grown = at(rows, 5)
    moved = [i for i, (shard, _) in grown.items() if shard != first[i][0]]
    assert {v for _, v in grown.values()} == {2} and {grown[i][0] for i in moved} == {4} and len(moved) < 700
    more = at(rows + [(i, "y" * 4000) for i in range(5000, 5040)], 5)
    assert {v for _, v in more.values()} <= {2, 3} and len(more) == 2040
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.save_map(sharding.load_map(spark, path, 1), path)


def test_rebalancing_nothing(docs, spark, tmp_path):
    stats = sharding.slot_stats(sharding.record_sizes(docs([]), 16))
    assert sharding.current_map(stats, str(tmp_path / "none"), 4).count() == 0
    one = spark.createDataFrame([(1, 3, 0)], "version int, virtual_slot int, shard int")
    assert sharding.rebalance(one, stats, 4).count() == 0
