"""Text operators look at every language, every visible element and every letter."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tamiz.llm import html, langid, toxicity


def invented(rng, letters, n):
    words = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(8)]
    return [" ".join(rng.choice(words) for _ in range(25)) for _ in range(n)]


def test_every_language_gets_a_model(docs):
    rng = random.Random(21)
    names = [f"l{k:02d}" for k in range(70)]
    rows = [(k * 10 + i, t, name) for k, name in enumerate(names) for i, t in enumerate(invented(rng, [chr(0x4E00 + 40 * k + j) for j in range(40)], 3))]
    frame = docs(rows)
    assert langid.fit(frame).languages == [*names, "und"]
    assert {r["doc_id"] for r in langid.keep_identified(frame).collect()} == {r[0] for r in rows}


def test_rare_language_beside_a_frequent_one(docs):
    rng = random.Random(22)
    rows = [(i, t, "en") for i, t in enumerate(invented(rng, "abcdefgh", 400))] + [(9000, *invented(rng, "mnopqrst", 1), "rare")]
    labelled = docs(rows + rows).selectExpr("doc_id", "lang", "text")
    taken = [r["lang"] for r in langid.language_sample(labelled, 20).collect()]
    assert (taken.count("en"), taken.count("rare")) == (20, 1)
    assert langid.fit(docs(rows), 20).languages == ["en", "rare", "und"]


@pytest.mark.parametrize(
    ("page", "declared"),
    [
        (f"<!-- {'licence ' * 900}--><html lang=de><p>x", "de"),
        (f"{' ' * 4090}<html class=wide lang='fr-CA'><p>x", "fr"),
        ("<!-- <html lang=en> --><html lang=es><p>x", "es"),
        ("<html><p>x<html lang=en>", ""),
    ],
)
def test_declaration_anywhere(page, declared, docs, spark):
    assert html.declared_language(page) == declared
    pages = spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string")
    model = langid.fit(docs([(1, "der die das", "de")]))
    assert [r["declared"] for r in langid.text_evidence(langid.page_records(pages), model).collect()] == [declared]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds", "so x=2 holds"),
        ("a <svg><title>no</title><defs><text>no</text></defs><rect/><desc/><text>North</text><g><text>South</text></g></svg> b", "a North South b"),
        ("<svg><text display='none'>no</text><foreignObject><p>in</p></foreignObject></svg>", "in"),
        ("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd></mtr></mtable></math>", "1 2 3"),
        ("say: <textarea>\nfirst &amp; one\n  second</textarea> end", "say: first & one\n  second end"),
        ("<select multiple><option>a<option>b</select> c", "a b c"),
        ("<select size=3><optgroup label=G><option>a<option hidden>x<option>b</optgroup></select>", "G a b"),
        ("<select><option>a<option selected>b</select> c", "b c"),
        ("<datalist><option>no</datalist>x", "x"),
    ],
)
def test_formulas_drawings_and_fields_are_visible(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><td>a<td>b</table>", "a  b"),
        ("<table><th>Name<th>Qty<tr><td>kiwi long<td>2</table>", "Name       Qty\nkiwi long  2"),
        ("<table><tbody><td>a</td><td>b</td><tr><td>c<td>d</tbody><tfoot><td>e<td>f</table>", "a  b\nc  d\ne  f"),
        ("<table><caption>C<td>a<td>b</table>", "C\na  b"),
        ("<table><colgroup><col><td>a<td>b</table>", "a  b"),
        ("<table><tr><td>a</tr><td>b<td>c</table>", "a\nb  c"),
        ("<table><form><td>a<td>b</form></table>", "a  b"),
        ("<table><td><table><td>a<td>b</table><td>c</table>", "a  b  c"),
    ],
)
def test_rows_that_the_markup_leaves_out(page, text):
    assert html.render(page) == text


def test_every_letter_of_a_run_counts():
    filler = "".join(random.Random(23).choice("abcdef") for _ in range(300))
    for run in (filler + "grolik", filler[:45] + "grolik" + filler):
        assert toxicity.word_features("grolik") & toxicity.word_features(run)
        make = toxicity.Features(wanted=toxicity.word_features("rolik"))
        assert len(make(f"x {run}")) and run not in make.words
    assert toxicity.word_features(filler + "x") != toxicity.word_features(filler + "y")


def test_language_of_a_long_run_is_not_that_of_its_head():
    rng = random.Random(24)
    head, rest = ("".join(rng.choice(x) for _ in range(n)) for x, n in (("abcdef", 40), ("mnopqr", 9000)))
    model = langid.TextModel.fitted(["".join(rng.choice(x) for _ in range(4000)) for x in ("abcdef", "mnopqr")], ["one", "two"])
    scorer = langid.Scorer(model)
    n, likelihood, units = scorer(head + rest)
    assert (n, units) == (1, 302) and model.languages[int(likelihood.argmax())] == "two"
    assert likelihood == pytest.approx(np.sum(model.logs[langid.word_grams(head + rest)], axis=0, dtype=np.float64), rel=1e-5)
    assert not scorer.places
