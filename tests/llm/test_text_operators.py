"""HTML rendering, language ID and toxicity: cases by hand, edges, held-out accuracy."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tamiz.llm import html, langid, toxicity

VOICES = {"en": "the of and to in is that it was for with as this by from", "de": "der die und den von ist nicht mit für das eine sich auch werden", "fr": "le la les de des et est que dans pour une qui sur avec", "es": "el los las de del que y en por una con para como más"}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b <b>c</b>", "a\n\nb c"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("x<br>y", "x\ny"),
        ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>z", "- x\n- y\n  3. q\n  4. r\n\nz"),
        ("<table><tr><th>Name<th>Qty<tr><td>kiwi long<td>2</table>", "Name       Qty\nkiwi long  2"),
        ("<table><caption>C</caption><tbody><tr><td colspan=2>a<td>b<tr><td>1<td>2<td>3</table>", "C\na     b\n1  2  3"),
        ("<title>t</title><style>p{}</style><script>var t='</p>';</script><p>seen", "seen"),
        ("<p hidden>no</p><p style='Display : none'>no</p><span style='visibility:hidden'>no</span>yes", "yes"),
        ("<!-- <p>no</p> -->a &amp; b&nbsp;&copy;", "a & b\xa0©"),
        ("<pre> a\n   b</pre>c", " a\n   b\n\nc"),
        ("a</b></p>b", "a\n\nb"),
        ("<a href='x>y'>link</a> tail", "link tail"),
        ("unclosed <b", "unclosed"),
        ("<blockquote>q</blockquote>", "  q"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<td>lone cell", "lone cell"),
        ("<select><option>no</select><noscript>no</noscript><button>go</button>", "go"),
    ],
)
def test_render(page, text):
    assert html.render(page) == text


def test_render_survives_anything():
    rng = random.Random(8)
    bits = ["<", ">", "</", "p", "div", "table", "tr", "td", "li", "ul", "a='", '"', "&", "&#x;", "x", " ", "\n", "<!--", "-->", "<script>", "<p>", "</table>"]
    for _ in range(500):
        assert isinstance(html.render("".join(rng.choice(bits) for _ in range(60))), str)
    assert html.render("<div>" * 5000 + "deep").strip() == "deep"


def test_declared_language():
    assert [html.declared_language(x) for x in ("<html lang=de-AT>", '<HTML class=x xml:lang="FR">', "<p lang=en>", None, "")] == ["de", "fr", "", "", ""]


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b"), (1, "u", "<p>a<p>b"), (2, None, None), (None, "v", "")], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_lines")
    got = sorted((tuple(r) for r in html.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a\n\nb", 4, 3), (1, "u", "a\n\nb", 4, 3), (2, None, "", 0, 0), (None, "v", "", 0, 0)], key=str)
    assert html.extract(pages.limit(0)).count() == 0


def spoken(rng, lang, n):
    return " ".join(rng.choice(VOICES[lang].split()) for _ in range(n))


def test_language_id(spark, docs, odd_rows):
    rng = random.Random(9)
    rows = [(i, spoken(rng, lang, rng.randint(4, 60)), lang, "s") for i, lang in enumerate(list(VOICES) * 40)]
    frame = docs(rows)
    model = langid.fit(frame)
    assert model.languages == [*sorted(VOICES), "und"]
    wrong = [(i, t, "en", "s") for i, t, lang, _ in rows if lang == "fr"][:3]
    asked = docs([(1000 + i, *r[1:]) for i, r in enumerate(rows)] + [(5000 + i, *r[1:]) for i, r in enumerate(wrong)] + [(9001, None, None, None), (9002, "", "en", "s"), (9003, "123 !!", "en", "s"), (None, spoken(rng, "de", 30), None, None)])
    got = {r["id"]: r for r in langid.identify(langid.document_records(asked), model).collect()}
    assert sum(got[1000 + i]["lang"] == r[2] for i, r in enumerate(rows)) >= 0.98 * len(rows)
    assert all(got[5000 + i]["lang"] == "fr" for i in range(3))  # the text outweighs the declaration
    assert all((got[i]["lang"], got[i]["accepted"], got[i]["words"]) == ("und", False, 0) for i in (9001, 9002, 9003))
    assert got[None]["lang"] == "de"
    assert langid.identify(langid.document_records(docs([])), model).count() == 0


def test_fusion_by_brute_force(spark, docs):
    """Priors and declarations as defined, in plain Python."""
    rng = random.Random(10)
    rows = [(i, spoken(rng, lang, 2), rng.choice(["en", "de", ""]), rng.choice("ab")) for i, lang in enumerate(["en", "de"] * 15)]
    model = langid.fit(docs([(i, spoken(rng, lang, 30), lang) for i, lang in enumerate(["en", "de"] * 20)]))
    got = {r["id"]: r for r in langid.identify(langid.document_records(docs(rows)), model).collect()}
    scorer, k = langid.Scorer(model), len(model.languages)
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    start = np.log([(1 - langid.UNKNOWN_SHARE) / (k - 1)] * (k - 1) + [langid.UNKNOWN_SHARE])
    like = {i: scorer(t)[1] for i, t, *_ in rows}
    own = {i: soft(like[i] + start) for i in like}
    total = sum(own.values())
    for i, _, declared, source in rows:
        host = [r[0] for r in rows if r[3] == source]
        said = [r[0] for r in rows if r[2] == declared]
        top = (total + langid.UNKNOWN_SHARE) / (len(rows) + langid.UNKNOWN_SHARE * k)
        middle = (total - own[i] + langid.LEVEL_PRIOR * top) / (len(rows) - 1 + langid.LEVEL_PRIOR)
        prior = (sum(own[j] for j in host) - own[i] + langid.LEVEL_PRIOR * middle) / (len(host) - 1 + langid.LEVEL_PRIOR)
        rate = (sum(own[j] for j in said) - own[i] + langid.DECLARED_PRIOR * len(said) / len(rows)) / (total + langid.DECLARED_PRIOR)
        p = soft(like[i] + np.log(np.maximum(prior, 1e-12)) + (np.log(np.maximum(rate, 1e-12)) if declared else 0))
        assert got[i]["probability"] == pytest.approx(p.max(), rel=1e-4) and got[i]["lang"] == model.languages[int(p.argmax())]


def test_keep_identified(docs, odd_rows):
    rng = random.Random(11)
    rows = [(100 + i, spoken(rng, lang, 20), lang) for i, lang in enumerate(list(VOICES) * 10)]
    frame = docs(rows + [(1, None), (2, ""), (3, "!?")])
    got = langid.keep_identified(frame)
    assert got.columns == frame.columns and {r["doc_id"] for r in got.collect()} == {r[0] for r in rows}
    assert langid.keep_identified(docs([])).count() == 0
    assert langid.keep_identified(docs(odd_rows)).count() <= len(odd_rows)


def test_host():
    assert langid.WORD.findall("ab1c d_é") == ["ab", "c", "d", "é"]


def toxic_rows(n):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text, bad = [rng.choice(words) for _ in range(rng.randint(20, 120))], rng.random() < 0.15
        if bad:
            text[3] = rng.choice(["grolik", "grolika", "zumpf"])
            text[9] = rng.choice(["vexxor", "zumpfen"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs):
    rows, labels = toxic_rows(1500)
    rows += [(5001, None), (5002, ""), (None, "no id"), (7, rows[7][1])]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.detect(docs(rows), frame.selectExpr("*", "1 as confirmed", "'x' as text")).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    truth = {i: t for i, _, t in labels}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    hit = sum(p and t for p, t in held)
    assert hit >= 0.9 * sum(t for _, t in held) and hit >= 0.9 * sum(p for p, _ in held)


def test_held_out_labels_change_nothing(spark, docs):
    rows, labels = toxic_rows(400)
    score = lambda ls: sorted((r["doc_id"], r["score"]) for r in toxicity.detect(docs(rows), spark.createDataFrame(ls, "doc_id long, quality int, toxic int")).collect())
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    assert score(labels) == score(flipped)


def test_toxicity_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.detect(docs([(1, "a b"), (2, None)]), none).collect()
    assert len(got) == 2 and len({r["score"] for r in got}) == 1
    assert toxicity.detect(docs([]), none).count() == 0


def test_risk_never_rewards_negative_parts():
    rows = [np.array([i % 3]) for i in range(30)]
    model = toxicity.train(rows[:10], rows, 0.3, dimension=8)
    assert np.isfinite(model.weights).all() and np.isfinite(model.bias) and (model.weights >= 0).all()
