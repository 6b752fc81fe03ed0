"""Training and scoring of toxicity against plain versions."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from tamiz.llm import toxicity


def plain_features(text):
    """Hashed words and their 4- and 5-grams, letter runs found one character at a time."""
    out, word = set(), ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            w = f"^{word}$"
            out |= {w} | {w[i : i + n] for n in (4, 5) for i in range(len(w) - n + 1)}
            word = ""
    return {zlib.crc32(x.encode()) % toxicity.DIMENSION for x in out}


def corpus(seed=41, n=400):
    rng = random.Random(seed)
    clean, bad = [f"{a}{b}" for a in ("haus", "baum", "feld", "wald") for b in ("tor", "rand", "weg")], ["grolik", "snarpo"]
    rows, marks = [], {}
    for i in range(n):
        toxic = rng.random() < 0.25
        rows.append((i, " ".join(rng.choices(clean, k=rng.randint(3, 20)) + ([rng.choice(bad)] if toxic else []))))
        if rng.random() < 0.6:
            marks[i] = int(toxic)
    return rows, marks


def test_features_are_those_of_a_plain_reader():
    make = toxicity.Features()
    for text in ("Don't grolik_7 Été", "", None, "ß" * 300, "漢字" * 3000 + " x"):
        assert set(make(text).tolist()) == plain_features(text)


def test_training_equals_a_plain_version():
    rows, marks = corpus()
    make = toxicity.Features()
    positive, unlabelled = [make(t) for i, t in rows if marks.get(i)], [make(t) for _, t in rows]
    prior, epochs, batch, rate, decay = 0.25, 3, 64, 0.01, 1e-3
    model = toxicity.train(positive, unlabelled, prior, epochs=epochs, batch=batch, rate=rate, decay=decay)
    index, ratio = toxicity.enriched(positive, unlabelled, prior, toxicity.DIMENSION)
    assert model.index.tolist() == index.tolist() and len(index)
    # the same descent row by row
    scale = dict(zip(index.tolist(), ratio.tolist(), strict=True))
    w = dict.fromkeys(scale, 0.0)
    bias = math.log(prior / (1 - prior))
    m, v, mb, vb, step = dict.fromkeys(scale, 0.0), dict.fromkeys(scale, 0.0), 0.0, 0.0, 0
    rng = np.random.default_rng(7)
    n_p = max(8, min(len(positive), batch // 2))
    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for start in range(0, len(order), batch):
            chosen = [positive[i] for i in rng.choice(len(positive), n_p, replace=len(positive) < n_p)]
            others = [unlabelled[i] for i in order[start : start + batch]]
            g = [bias + sum(w[f] * scale[f] for f in r.tolist() if f in scale) for r in [*chosen, *others]]
            p = [1 / (1 + math.exp(-x)) for x in g]
            negative = [math.log1p(math.exp(x)) for x in g]
            excess = np.mean(negative[n_p:]) - prior * np.mean(negative[:n_p])
            if excess >= 0:
                slope = [-prior / n_p] * n_p + [x / len(others) for x in p[n_p:]]
            else:
                slope = [prior * x / n_p for x in p[:n_p]] + [-x / len(others) for x in p[n_p:]]
            step += 1
            size = rate * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for f in scale:
                grad = sum(s for s, r in zip(slope, [*chosen, *others], strict=True) if f in set(r.tolist())) * scale[f] + decay * w[f]
                m[f], v[f] = 0.9 * m[f] + 0.1 * grad, 0.999 * v[f] + 0.001 * grad * grad
                w[f] = max(w[f] - size * m[f] / (math.sqrt(v[f]) + 1e-8), 0.0)
            mb, vb = 0.9 * mb + 0.1 * sum(slope), 0.999 * vb + 0.001 * sum(slope) ** 2
            bias -= size * mb / (math.sqrt(vb) + 1e-8)
    assert model.bias == pytest.approx(bias, rel=1e-6)
    assert model.weights.tolist() == pytest.approx([w[f] * scale[f] for f in index.tolist()], rel=1e-5, abs=1e-9)


def test_fit_and_scores_equal_a_plain_version(docs, spark):
    """Distributed counts find the features of the plain version; every whole text has the plain score."""
    rows, marks = corpus()
    rows += [(1000, None), (1001, ""), (1002, "haustor " * 60_000 + "grolik"), (1003, "grolik" * 20_000)]
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    frame = docs([*rows, rows[3], (3, "zzz another text of the same id")])
    sample, prior = toxicity.training_sample(frame, labels)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learnt = [v for i, v in marks.items() if not held(i)]
    assert prior == pytest.approx((sum(learnt) + 0.5) / (len(learnt) + 1))
    taken = sample.collect()
    assert sorted((r["doc_id"], r["confirmed"]) for r in taken) == sorted([(i, True) for i, v in marks.items() if v and not held(i)] + [(i, False) for i, _ in rows if not held(i)])
    index, ratio = toxicity.enriched_features(toxicity.feature_rows(sample), prior)
    make = toxicity.Features()
    expected = toxicity.enriched([make(r["text"]) for r in taken if r["confirmed"]], [make(r["text"]) for r in taken if not r["confirmed"]], prior, toxicity.DIMENSION)
    assert index.tolist() == expected[0].tolist() and ratio.tolist() == pytest.approx(expected[1].tolist(), rel=1e-12)
    model = toxicity.fit(frame, labels)
    weights = dict(zip(model.index.tolist(), model.weights.tolist(), strict=True))
    text = dict(rows)
    for r in toxicity.score(docs(rows), model).collect():
        g = model.bias + sum(weights.get(f, 0.0) for f in plain_features(text[r["doc_id"]]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-g)), rel=1e-9)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs(rows), model).collect()}
    assert scores[1000] == scores[1001] < scores[1003] and scores[1002] > 0.3
