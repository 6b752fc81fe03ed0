"""N-gram Jaccard join and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from tamiz.llm import common, line_dedup, near_dups
from tamiz.llm.components import components


def roots(nodes, pairs):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    expected = roots({x for p in pairs for x in p}, pairs)
    assert got == {x: r for x, r in expected.items() if x in got}
    assert set(got) == {x for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_band_choice_meets_the_recall():
    bands, rows = near_dups.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    assert near_dups.choose_bands(0.8, 0.9)[0] < bands


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_rows():
    rng = random.Random(5)
    rows = []
    for base in range(6):
        words = [f"w{base}x{rng.randrange(900)}" for _ in range(120)]
        for k in range(40 if base == 0 else 3):  # the first group is beyond the size of a small bucket
            own = list(words)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    return [*rows, (500, rows[0][1]), (501, rows[0][1].upper()), (502, "one two"), (503, "One  two"), (504, "one two three")]


def expected_links(rows):
    sets = [grams(t) for _, t, *_ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    count = defaultdict(int)
    for a, b in pairs:
        count[a] += 1
        count[b] += 1
    return pairs, count


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates(docs, odd_rows, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rows = near_rows() + ([(r[0] + 1000 if r[0] else None, *r[1:]) for r in odd_rows] if block == 256 else [])
    got = near_dups.near_duplicates(docs(rows)).collect()
    pairs, count = expected_links(rows)
    label = roots(range(len(rows)), pairs)
    members = defaultdict(list)
    for i, r in label.items():
        members[r].append(rows[i][0])
    least = {i: min((x for x in members[r] if x is not None), default=None) for i, r in label.items()}
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=lambda x: str(x)) == sorted(((rows[i][0], least[i], count[i]) for i in range(len(rows))), key=lambda x: str(x))
    assert sum(r["kept"] for r in got) == len(members)
    assert len({r["class_id"] for r in got if r["kept"] and r["class_id"] is not None}) >= len(members) - 2


def test_near_duplicates_of_nothing(docs):
    assert near_dups.near_duplicates(docs([])).count() == 0
    got = near_dups.near_duplicates(docs([(1, None), (2, ""), (3, " \n")])).collect()
    assert {(r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in got} == {(i, i, 0, True) for i in (1, 2, 3)}


def test_drop_near_duplicates_keeps_columns(docs):
    frame = docs([(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None)])
    got = near_dups.drop_near_duplicates(frame)
    assert got.columns == frame.columns and sorted(r["doc_id"] for r in got.collect()) == [2, 3]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def changed(rng, s, n):
    out = list(s)
    for _ in range(n):
        i = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(i, rng.choice("abcé"))
        elif out:
            i = min(i, len(out) - 1)
            out[i : i + 1] = [] if kind == 1 else [rng.choice("abcdé")]
    return "".join(out)


def test_banded_distance_and_segments():
    rng = random.Random(6)
    for _ in range(3000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(1, 90)))
        b = changed(rng, a, rng.randrange(6))
        d = edits(a, b)
        assert [line_dedup.distance_within(a, b, k) for k in (1, 2, 4)] == [d <= k for k in (1, 2, 4)]
        short, long = sorted((a, b), key=len)
        assert d > 2 or len(short) < 9 or line_dedup.first_shared_segment(short, long) >= 0


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    found = [(i is not None, i or 0, k, n, line.strip(strip)) for k, (i, t, *_) in enumerate(rows) for n, line in enumerate((t or "").split("\n"))]
    found = [f for f in found if f[4]]
    lines = sorted({f[4] for f in found})
    long = [x for x in lines if len(x) >= line_dedup.SHORTEST]
    pairs = [(a, b) for i, a in enumerate(long) for b in long[:i] if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2]
    return found, roots(lines, pairs), pairs


@pytest.mark.parametrize("block", [128, 4])
def test_line_dedup(docs, odd_rows, block, monkeypatch):
    monkeypatch.setattr(line_dedup.edit_links, "__defaults__", (line_dedup.EDITS, line_dedup.SHORTEST, block))
    rng = random.Random(7)
    bases = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(15, 60))).strip() + "." for _ in range(12)]
    rows = [(i, "\n".join([changed(rng, rng.choice(bases), rng.randrange(4)) for _ in range(5)] + ["", "short", " " + bases[0] + "\t"])) for i in range(30)]
    rows += [(r[0] + 100 if r[0] else None, *r[1:]) for r in odd_rows if len(r[1] or "") < 1000]
    marked = line_dedup.mark_lines(docs(rows))
    got = marked.collect()
    found, label, pairs = brute_lines(rows)
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    first = {}
    for f in sorted(found):
        first.setdefault(label[f[4]], f)
    for k, (i, _, *_) in enumerate(rows):
        if i == 107:  # repeated rows: told apart by row only
            continue
        own = [f for f in found if f[2] == k]
        assert (by[i]["n_lines"], by[i]["n_links"]) == (len(own), sum(links[f[4]] for f in own))
        assert by[i]["dropped"] == [f[3] for f in own if first[label[f[4]]] != f]
    assert sum(r["n_kept"] for r in got) == len(first)


def test_line_classes(docs):
    """Every line of a class that has others names the line that stays for it; lines from nine characters are linked."""
    rng = random.Random(17)
    bases = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (9, 10, 12, 19, 30)]
    rows = [(i, "\n".join([changed(rng, rng.choice(bases), rng.randrange(3)) for _ in range(4)] + [f"own line of number {i * 7919}", "eight8ch"[: rng.randint(7, 8)]])) for i in range(25)]
    got = {r["doc_id"]: r for r in line_dedup.mark_lines(docs(rows), classes=True).collect()}
    found, label, pairs = brute_lines(rows)
    assert any(9 <= len(a) < 20 for a, _ in pairs)
    links, first, size = defaultdict(int), {}, defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for f in sorted(found):
        first.setdefault(label[f[4]], f)
        size[label[f[4]]] += 1
    for i, r in got.items():
        own = [f for f in found if f[1] == i and size[label[f[4]]] > 1]
        assert [tuple(x) for x in r["line_classes"]] == [(f[3], first[label[f[4]]][1], first[label[f[4]]][3], links[f[4]]) for f in own]


def test_a_line_that_most_documents_share(docs, monkeypatch):
    """Rows of a hot line are not gathered, and get the same marks."""
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = [(i, f"the line that all documents share\n{hashlib.md5(b'%d' % i).hexdigest()} alone here\nnumber {i % 3} of three") for i in range(60)]
    got = line_dedup.mark_lines(docs(rows)).collect()
    assert sum(r["n_kept"] for r in got) == 1 + 60 + 1 and {len(r["dropped"]) for r in got if r["doc_id"]} == {2}


def test_very_long_lines(docs):
    """Lines of a hundred thousand characters are linked as others are."""
    rng = random.Random(18)
    long = "".join(rng.choice("abcdefgh ") for _ in range(100_000)).strip()
    got = {r["doc_id"]: (r["n_links"], r["dropped"]) for r in line_dedup.mark_lines(docs([(1, long), (2, long[:50_000] + "X" + long[50_000:]), (3, long[:70_000] + "YYY" + long[70_000:]), (4, long)])).collect()}
    assert got == {1: (1, []), 2: (1, [0]), 3: (0, []), 4: (1, [0])}


def test_drop_lines(docs):
    frame = docs([(1, "one line that is long enough\nb\n\nx"), (2, "b\none line that is long enough!\nnew"), (3, None)])
    marked = line_dedup.mark_lines(frame)
    out = line_dedup.drop_lines(frame, marked)
    assert out.columns == frame.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "one line that is long enough\nb\n\nx", 2: "new", 3: None}
    assert line_dedup.mark_lines(docs([])).count() == 0


def test_schema(docs):
    assert line_dedup.mark_lines(docs([])).columns == ["doc_id", "n_lines", "n_kept", "n_links", "dropped", "text_hash"]


def test_recall_on_a_given_table(spark):
    """Every link of a table with planted copies, found by comparing all documents that share an n-gram."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    sets = [grams(t) for _, t in rows]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            at[g].append(i)
    shared = defaultdict(int)
    for owners in at.values():
        for k, a in enumerate(owners):
            for b in owners[:k]:
                shared[a, b] += 1
    links = defaultdict(int)
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
    assert sum(links.values()) > 100
    got = {r["doc_id"]: r["n_links"] for r in near_dups.near_duplicates(table).collect()}
    assert got == {i: links[k] for k, (i, _) in enumerate(rows)}
