"""Visibility, spans and odd markup; random pages against an independent reader of visible words."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pytest

from tamiz.llm import html

NINES, ZEROS = "9" * 5000, "0" * 5000


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<table><td colspan={NINES}>x</table>&#{NINES};y&#{ZEROS}65;&#x{'f' * 5000};", "x\n\n�yA�"),
        (f"<table><tr><td rowspan={NINES}>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<div>" * 300 + "<div hidden>no</div>" + "</div>" * 300 + "yes", "yes"),
        ("<div>" * 50_000 + "<p hidden>no</p>yes", "yes"),
        ("<blockquote>" * 2000 + "deep", "  " * 2000 + "deep"),
        ("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</p>", "yes"),
        ("<p style='visibility:collapse'>no</p>x", "x"),
        ("<div style='display:none'><b style='display:block;visibility:visible'>no</b></div>x", "x"),
        ("<div hidden style='display:block'>shown</div>", "shown"),
        ("<details>no<summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
        ("<style>.x{display:none}</style><p class='a x'>no</p><p class=xx>yes</p>", "yes"),
        ("<style>.x{display:none}</style><p class=x style='display:block'>yes</p>", "yes"),
        ("<style>.x{display:none !important}</style><p class=x style='display:block'>no</p>y", "y"),
        ("<style>div > p b, #i.j{visibility:hidden}</style><div><p>a <i><b>no</b></i></p></div><b>c</b><u id=i class=j>no</u><u id=i>d</u>", "a\n\ncd"),
        ("<style>/* p{display:none} */ p{display:none} .y{display:block}</style><p>no</p><p class=y>yes</p>", "yes"),
        ("<style>@media print{p{display:none}} @media screen{b{display:none}} p:hover{display:none}</style><p>a<b>no</b></p>", "a"),
        ("<style>[data-x=\"1\"]{display:none}</style><p data-x=1>no</p><p data-x=2>yes</p>", "yes"),
        ("<style>div>p{display:none}</style><div><section><p>yes</p></section><p>no</p></div>", "yes"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr style='visibility:collapse'><td>no<tr><td>x<td hidden>no<td>y</table>", "x  y"),
        ("<table><tr><td>a<td>b<tr><td colspan=2>cc<td>d</table>", "a   b\ncc    d"),
    ],
)
def test_visibility_and_spans(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize("wide", [201, 250, 5000])
def test_columns_stay_aligned_however_wide(wide):
    lines = html.render(f"<table><tr><td>{'w' * wide}<td>X<tr><td>s<td>Y</table>").split("\n")
    assert [line.index(c) for line, c in zip(lines, "XY", strict=True)] == [wide + 2] * 2


def test_a_table_with_too_much_padding_keeps_its_text():
    text = html.render("<table><tr><td>" + "w" * 1_000_000 + "<td>b" + "<tr><td>a<td>b" * 2000 + "</table>")
    assert len(text) < 2_000_000 and text.count("\na  b") == 2000


def test_a_very_long_page():
    words = [f"w{i}" for i in range(200_000)]
    assert html.render("".join(f"<p>{w}" for w in words)).split() == words


class Reader(HTMLParser):
    """Visible words of well-formed pages in order, by a stack of what hides."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, bool, bool]] = []  # name, gone, veiled
        self.words: list[str] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        gone, veiled = (self.open[-1][1:]) if self.open else (False, False)
        style = attrs.get("style", "")
        gone = gone or "hidden" in attrs or "display:none" in style or tag in ("script", "template") or "no" in attrs.get("class", "").split()
        veiled = "visibility:hidden" in style or (veiled and "visibility:visible" not in style)
        if tag != "br":
            self.open.append((tag, gone, veiled))

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        if not self.open or not (self.open[-1][1] or self.open[-1][2]):
            self.words += data.split()


def _page(rng: random.Random, depth: int, counter: list[int]) -> str:
    """Random well-formed markup; every word is new."""

    def word() -> str:
        counter[0] += 1
        return f" w{counter[0]}&amp;{counter[0]} "

    def attrs() -> str:
        return rng.choice(["", "", "", "", " hidden", " style='display:none'", " style='visibility:hidden'", " style='visibility:visible'", " class='a no'", " class=a"])

    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "div", "span", "ul", "table", "blockquote", "section"]) if depth else "text"
        inner = lambda: _page(rng, depth - 1, counter)
        if kind == "text":
            out.append(word())
        elif kind == "ul":
            out.append(f"<ul{attrs()}>" + "".join(f"<li{attrs()}>{inner()}</li>" for _ in range(rng.randint(1, 3))) + "</ul>")
        elif kind == "table":
            rows = "".join(f"<tr{attrs()}>" + f"<td{attrs()}>{word()}</td>" * 1 + "</tr>" for _ in range(rng.randint(1, 3)))
            out.append(f"<table{attrs()}><tbody>{rows}</tbody></table>")
        else:
            out.append(f"<{kind}{attrs()}>{inner()}</{kind}>")
    return "".join(out)


def test_random_pages_show_the_words_that_another_reader_sees():
    rng = random.Random(31)
    for _ in range(300):
        page = _page(rng, 4, [0])
        reader = Reader()
        reader.feed(page)
        shown = html.render(f"<style>.no {{ display: none }}</style>{page}").split()
        assert [w for w in shown if w != "-"] == reader.words  # without list markers
