"""Hosts, suffixes and declared markup of pages by brute force; held-out accuracy without the label as evidence."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.llm import html, langid

VOICES = {"de": "der die und ist nicht ein Haus zwischen wieder straße", "en": "the and with house which there would between", "fr": "les est dans maison avec une être voilà"}


def spoken(rng, lang, n):
    return " ".join(rng.choice(VOICES[lang].split()) for _ in range(n))


@pytest.mark.parametrize(
    ("url", "host", "suffix"),
    [
        ("https://Www.Example.DE:8080/a?b#c", "www.example.de", "de"),
        ("ftp://user:pw@files.example.co.uk", "files.example.co.uk", "uk"),
        ("http://localhost/x", "localhost", "localhost"),
        ("//no.scheme.fr/x", "", ""),
        ("no address", "", ""),
        ("", "", ""),
        (None, "", ""),
        ("https://a.example?q=http://b.example", "a.example", "example"),
    ],
)
def test_host_and_suffix(spark, url, host, suffix):
    row = langid.page_records(spark.createDataFrame([(1, url, "x")], "page_id long, url string, html string")).first()
    assert (row["host"], row["suffix"]) == (host, suffix)


def test_pages_by_brute_force(spark, docs):
    """Text, declaration, suffix and host as defined, in plain Python, ties and clashing columns included."""
    rng = random.Random(51)
    model = langid.fit(docs([(i, spoken(rng, lang, 30), lang) for i, lang in enumerate(list(VOICES) * 15)]))
    pages = []
    for i in range(60):
        lang = rng.choice(list(VOICES))
        said, host = rng.choice([lang, lang, "", "en", "xx"]), rng.choice([f"a.{lang}", "b.de", "b.com", "c.com"])
        pages.append((i, f"http://{host}/p{i}", f"<html{f' lang={said}' if said else ''}><body><p hidden>the and with</p><p>{spoken(rng, lang, rng.randint(0, 4))}</p>"))
    pages += [pages[0], (100, None, None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as words", "'x' as lang")
    got = langid.identify(langid.page_records(frame), model).collect()
    k, n = len(model.languages), len(pages)
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    start = np.log([(1 - langid.UNKNOWN_SHARE) / (k - 1)] * (k - 1) + [langid.UNKNOWN_SHARE])
    text, said, host, suffix = [], [], [], []
    for _, url, page in pages:
        words = [w for w in (html.render(page)).lower().split()]
        text.append(sum((model.logs[langid.word_grams(w)].sum(axis=0, dtype=np.float64) for w in words), np.zeros(k)))
        said.append(page.partition("lang=")[2].partition(">")[0] if page and "lang=" in page else "")
        host.append((url or "http:///").split("/")[2])
        suffix.append(host[-1].rpartition(".")[2])
    own = [soft(t + start) for t in text]
    total = sum(own)
    expected = []
    for i in range(n):
        group = lambda values, i=i: [own[j] for j in range(n) if values[j] == values[i]]
        h, s, d = group(host), group(suffix), group(said)
        top = (total + langid.UNKNOWN_SHARE) / (n + langid.UNKNOWN_SHARE * k)
        middle = (sum(s) - own[i] + langid.LEVEL_PRIOR * top) / (len(s) - 1 + langid.LEVEL_PRIOR)
        prior = (sum(h) - own[i] + langid.LEVEL_PRIOR * middle) / (len(h) - 1 + langid.LEVEL_PRIOR)
        rate = (sum(d) - own[i] + langid.DECLARED_PRIOR * len(d) / n) / (total + langid.DECLARED_PRIOR)
        p = soft(text[i] + np.log(np.maximum(prior, 1e-12)) + (np.log(np.maximum(rate, 1e-12)) if said[i] else 0))
        silent = not html.render(pages[i][2]).split()
        expected.append((pages[i][0], "und" if silent else model.languages[int(p.argmax())], 1.0 if silent else p.max(), said[i]))
    order = lambda r: (r[0], r[1])
    got = sorted(((r["id"], r["lang"], r["probability"], r["declared"]) for r in got), key=order)
    for g, e in zip(got, sorted(expected, key=order), strict=True):
        assert (g[0], g[1], g[3]) == (e[0], e[1], e[3]) and g[2] == pytest.approx(e[2], rel=1e-4)


def test_the_fit_equals_a_plain_count(docs):
    """Counts summed over partitions give the model of all texts at once; a repeated id takes part once for each label."""
    rng = random.Random(52)
    rows = [(i, spoken(rng, lang, 20), lang) for i, lang in enumerate(list(VOICES) * 20)] + [(900, "... 12", "none")]
    model = langid.fit(docs(rows + rows[:30]).repartition(7))
    plain = langid.TextModel.fitted([r[1] for r in rows], [r[2] for r in rows])
    assert model.languages == plain.languages and np.allclose(model.logs, plain.logs, rtol=1e-6)


def test_held_out_text_without_the_label(spark):
    """Models of three quarters of the documents read the language of the others from their text alone."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(table.where(~held))
    asked = table.where(held).withColumn("said", F.col("lang")).withColumn("lang", F.lit(None).cast("string"))
    got = {r["id"]: r["text_lang"] for r in langid.identify(langid.document_records(asked), model).where("words > 0").collect()}
    truth = {r["doc_id"]: r["said"] for r in asked.collect() if r["doc_id"] in got}
    assert len(got) > 200 and np.mean([got[i] == truth[i] for i in got]) > 0.97
