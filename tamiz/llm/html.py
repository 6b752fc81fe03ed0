"""Layout-aware HTML rendering: a tree builder with implied tags, then visible text.

The builder opens and closes what the markup leaves out (html, body, p, li, rows,
cells), the renderer drops what a browser would not show (see ``visibility``), and prints
blocks apart, lists with markers and indents, and table cells in aligned columns. Nothing
limits depth, width or length: a colspan or rowspan of any number of digits counts as the most that HTML
allows, and elements nest without bound.
"""

from __future__ import annotations

import bisect
import re
import sys
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.visibility import Node, entities, mark

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
SPACE = re.compile(r"[ \t\n\r\f]+")

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Drawings and formulas: what they hold without showing it, and the parts whose text stands apart from its neighbours'.
FOREIGN = frozenset("svg math".split())
UNSHOWN = frozenset("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter script style annotation annotation-xml".split())
APART = frozenset("svg g text mtr mlabeledtr mtd foreignobject".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure fieldset hr".split())
CLOSES_P = (BLOCK | {"table"}) - {"html", "body", "caption", "legend"}
TABLE_PARTS = frozenset("table thead tbody tfoot tr".split())
#: A start tag closes these open elements, looking no further than the given ancestors.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
HEAD_ONLY = frozenset("base link meta title style script template noscript head".split())
#: What ends the search for a paragraph to close, and where a cell may stand without a row.
P_SCOPE = ("td", "th", "table", "li", "button", "caption")
SECTIONS = ("table", "thead", "tbody", "tfoot")
# The most columns and rows that HTML lets a cell span.
COLSPAN, ROWSPAN = 1000, 65534
#: Padding that a table may have, besides 16 times its text; one that would need more keeps all its text, but unaligned.
PADDING = 1 << 22


class _Open:
    """The open elements, and at which depths those of a name stand: no step looks through all of them."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.at: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, upto: int) -> None:
        """Close the elements from depth ``upto`` on; the root stays."""
        while len(self.stack) > upto:
            self.at[self.stack.pop().name].pop()

    def inner(self, names: Iterable[str]) -> int:
        """The depth of the innermost open element with one of these names, or 0."""
        return max((places[-1] for n in names if (places := self.at.get(n))), default=0)

    def outer(self, names: Iterable[str], above: int) -> int:
        """The depth of the outermost one that is deeper than ``above``, or 0."""
        found = [places[k] for n in names if (places := self.at.get(n)) and (k := bisect.bisect_right(places, above)) < len(places)]
        return min(found, default=0)


def parse(html: str) -> Node:
    """The tree of a page. Any input gives one: unmatched end tags are dropped, open elements end with the page."""
    root = Node("html")
    opened = _Open(root)
    stack = opened.stack
    body: Node | None = None
    begun = False

    def add(name: str, attrs: str = "") -> Node:
        node = Node(name, attrs)
        stack[-1].children.append(node)
        return node

    def in_body() -> None:
        nonlocal body
        if body is None:
            opened.close(1)
            body = add("body")
            opened.push(body)

    def in_foreign(name: str) -> bool:
        """Whether an element is part of a drawing or formula, where a slash closes it."""
        return name in FOREIGN or opened.inner(FOREIGN) > opened.inner(("foreignobject",))

    def implied_row() -> None:
        """A row for a cell that starts in a table or a section of one, outside any row."""
        section = opened.inner(SECTIONS)
        if section > opened.inner(("tr", "td", "th")):
            opened.close(section + 1)
            opened.push(add("tr"))

    def text(s: str) -> None:
        if not s:
            return
        if stack[-1] is root or stack[-1].name == "head":
            if not s.strip():
                return
            in_body()
        stack[-1].children.append(entities(s))

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if name == "p" and not opened.at.get("p"):
                in_body()
                add("p")
                continue
            barrier = ("td", "th", "table") if name not in TABLE_PARTS and name not in ("td", "th") else ("table",) if name != "table" else ()
            depth = opened.inner((name,))
            if depth and depth >= opened.inner(barrier) and stack[depth] is not body:
                opened.close(depth)
            continue
        if name == "html":
            if not begun:
                root.attrs, begun = m["attrs"], True
            continue
        if name == "body":
            in_body()
            body.attrs = body.attrs or m["attrs"]
            continue
        if name == "head":
            if body is None and stack[-1] is root:
                opened.push(add("head", m["attrs"]))
            continue
        if (name not in HEAD_ONLY or body is not None) and (stack[-1] is root or stack[-1].name == "head"):
            in_body()
        if name in CLOSES_P:
            depth = opened.inner(("p",))
            if depth > opened.inner(P_SCOPE):
                opened.close(depth)
        if name in IMPLIED_END:
            ends, scope = IMPLIED_END[name]
            depth = opened.outer(ends, opened.inner(scope))
            if depth:
                opened.close(depth)
        if name in ("td", "th"):
            implied_row()
        node = add(name, m["attrs"])
        if name in RAW:
            stop = _end_of(name).search(html, at)
            upto = stop.start() if stop else end
            node.children.append(entities(html[at:upto]) if name == "textarea" else html[at:upto])
            at = html.find(">", upto) + 1 or end if stop else end
        elif name not in VOID and not (m["attrs"].endswith("/") and in_foreign(name)):
            opened.push(node)
    return root


@cache
def _end_of(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


class _Lines:
    """Lines under construction; margins collapse as between blocks."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.gap = 0

    def put(self, s: str) -> None:
        """Text in which white space collapses, also across elements."""
        s = SPACE.sub(" ", s)
        if s and s[0] == " " and (not self.now or self.now[-1].endswith((" ", "\n"))):
            s = s[1:]
        if s:
            self.open()
            self.now.append(s)

    def open(self) -> None:
        if not self.now and self.gap and self.done:
            self.done += [""] * (self.gap - 1)
        self.gap = 0

    def end(self, gap: int = 1) -> None:
        if self.now:
            self.done += "".join(self.now).rstrip(" ").split("\n")
            self.now = []
        self.gap = max(self.gap, gap)

    def block(self, lines: list[str], first: str = "", rest: str = "") -> None:
        """Lines of an inner block, the first with a marker."""
        self.end(self.gap)
        if lines:
            self.open()
            self.done += [(first if i == 0 else rest) + x if x or i == 0 else "" for i, x in enumerate(lines)]
            self.done[-len(lines) :] = [x.rstrip() for x in self.done[-len(lines) :]]

    def result(self) -> list[str]:
        self.end()
        return self.done


def _span(cell: Node, name: str, most: int, none: int) -> int:
    """A cell's colspan or rowspan, however many digits it has; 0 means ``none``, other values that are no number mean 1."""
    if name not in cell.attrs.lower():
        return 1
    found = re.match(r"\s*\+?0*([0-9]+)", cell.attributes().get(name, ""))
    if found is None:
        return 1
    return (min(int(found[1]), most) if len(found[1]) < 6 else most) or none


class _Grid:
    """Rows of a table as cells by column; a cell of several rows keeps its columns taken in the rows below."""

    def __init__(self) -> None:
        self.rows: list[dict[int, list[str]]] = []
        self.taken: dict[int, int] = {}

    def section(self) -> None:
        """Cells do not reach into the next section."""
        self.taken = {}

    def row(self, cells: list[Node]) -> None:
        out, below, column = {}, {}, 0
        for cell in cells:
            while column in self.taken:
                column += 1
            wide, tall = _span(cell, "colspan", COLSPAN, 1), _span(cell, "rowspan", ROWSPAN, ROWSPAN)
            out[column] = _flow(cell)
            if tall > 1:
                below.update(dict.fromkeys(range(column, column + wide), tall))
            column += wide
        self.taken = {c: n - 1 for c, n in {**self.taken, **below}.items() if n > 1}
        if out:
            self.rows.append(out)


def _table(node: Node) -> tuple[list[dict[int, list[str]]], list[str]]:
    """Rows of cells by column, each a list of lines, and the caption."""
    grid = _Grid()
    caption: list[str] = []
    loose: list = []

    def row(found: Node) -> None:
        grid.row([x for x in found.children if isinstance(x, Node) and x.name in ("td", "th") and not x.gone])
        loose.extend(x for x in found.children if (x.name not in ("td", "th") if isinstance(x, Node) else x.strip() and not found.veiled))

    for part in node.children:
        if isinstance(part, str):
            if part.strip() and not node.veiled:
                loose.append(part)
        elif part.gone:
            continue
        elif part.name == "caption":
            caption += _flow(part)
        elif part.name == "tr":
            row(part)
        elif part.name in ("thead", "tbody", "tfoot"):
            grid.section()
            for inner in part.children:
                if isinstance(inner, Node) and inner.name == "tr":
                    if not inner.gone:
                        row(inner)
                elif isinstance(inner, Node) or (inner.strip() and not part.veiled):
                    loose.append(inner)
            grid.section()
        else:
            loose.append(part)
    if loose:
        holder = Node("div")
        holder.children = loose
        caption = _flow(holder) + caption
    return grid.rows, caption


def _aligned(rows: list[dict[int, list[str]]]) -> list[str]:
    """Cells padded to the width of their column, however wide, columns two spaces apart."""
    width: dict[int, int] = {}
    for r in rows:
        last = max(r)
        for i, cell in r.items():
            if i != last:
                width[i] = max(width.get(i, 0), *(len(x) for x in cell), 0)
    start, places = 0, []
    for i in range(max((max(r) for r in rows), default=-1) + 1):
        places.append(start)
        start += width.get(i, 0) + 2
    aligned = sum(places[max(r)] for r in rows) <= PADDING + 16 * sum(len(x) for r in rows for cell in r.values() for x in cell)
    out = []
    for r in rows:
        for k in range(max(len(c) for c in r.values())):
            line, upto = [], 0
            for i, cell in r.items():
                if k < len(cell) and cell[k]:
                    if aligned:
                        line.append(" " * (places[i] - upto))
                        upto = places[i] + len(cell[k])
                    elif line:
                        line.append("  ")
                    line.append(cell[k])
            out.append("".join(line).rstrip())
    return out


def _foreign(node: Node, lines: _Lines, depth: int, pre: bool) -> None:
    """Text of a drawing or formula, inline; labels and cells stand apart."""
    for child in node.children:
        if isinstance(child, str):
            if not node.veiled:
                lines.put(child)
        elif child.name not in UNSHOWN and not child.gone and not ("display" in child.attrs and child.attributes().get("display", "").strip() == "none"):
            if child.name in APART:
                lines.put(" ")
            if child.name == "foreignobject":
                _render(child, lines, depth, pre)
            else:
                _foreign(child, lines, depth, pre)
            if child.name in APART:
                lines.put(" ")


def _options(node: Node, all_of_them: bool) -> list[Node]:
    """Options of a list box, all of them; of a closed list, which shows one value, the last that the markup selects."""
    found: list[Node] = []
    for child in node.children:
        if isinstance(child, Node) and not child.gone:
            if child.name == "option":
                found.append(child)
            elif child.name == "optgroup" and all_of_them:
                head = Node("optgroup", veiled=child.veiled)
                head.children = [child.attributes().get("label", "")]
                found += [head, *_options(child, True)]
            else:
                found += _options(child, True)
    return found if all_of_them else [x for x in found if x.name == "option" and "selected" in x.attributes()][-1:]


def _flow(node: Node) -> list[str]:
    lines = _Lines()
    _render(node, lines, 0, False)
    return lines.result()


def _render(node: Node, lines: _Lines, depth: int, pre: bool) -> None:
    for child in node.children:
        if isinstance(child, str):
            if node.veiled:
                continue
            if pre:
                if child:
                    lines.open()
                    lines.now.append(child.replace("\r\n", "\n").expandtabs())
            else:
                lines.put(child)
            continue
        name = child.name
        if child.gone:
            continue
        if name == "br":
            lines.open()
            if lines.now:
                lines.now[-1] = lines.now[-1].rstrip(" ")
            lines.now.append("\n")
        elif name == "wbr":
            continue
        elif name == "hr":
            lines.end(2)
        elif name == "img":
            continue
        elif name == "input":
            attrs = child.attributes()
            if not child.veiled and attrs.get("type", "text").lower() in ("button", "submit", "reset", "text", "email", "search", "url", "tel", "number"):
                lines.put(attrs.get("value", ""))
        elif name in FOREIGN:
            _foreign(child, lines, depth, pre)
        elif name == "textarea":
            held = Node("span", veiled=child.veiled)
            held.children = [x[1:] if x.startswith("\n") else x for x in (c.replace("\r\n", "\n") for c in child.children if isinstance(c, str))]
            _render(held, lines, depth, True)
        elif name == "select":
            attrs = child.attributes()
            size = re.fullmatch(r"\s*(\d{1,9})\s*", attrs.get("size", ""))
            for option in _options(child, "multiple" in attrs or bool(size and int(size[1]) > 1)):
                lines.put(" ")
                _render(option, lines, depth, False)
                lines.put(" ")
        elif name in ("ul", "ol", "menu", "dir"):
            gap = 1 if depth else 2
            lines.end(gap)
            number = 1
            if name == "ol":
                start = re.fullmatch(r"\s*(-?\d{1,9})\s*", child.attributes().get("start", ""))
                number = int(start[1]) if start else 1
            for item in child.children:
                if isinstance(item, str):
                    if not child.veiled:
                        lines.put(item)
                    continue
                if item.gone:
                    continue
                holder = _Lines()
                if item.name == "li":
                    _render(item, holder, depth + 1, pre)
                    mark = f"{number}. " if name == "ol" else "- "
                    number += 1
                    lines.end(1)
                    lines.block(holder.result(), mark, " " * len(mark))
                    lines.end(1)
                else:
                    outer = Node("div", veiled=child.veiled)
                    outer.children = [item]
                    _render(outer, holder, depth + 1, pre)
                    lines.end(1)
                    lines.block(holder.result(), "  ", "  ")
                    lines.end(1)
            lines.end(gap)
        elif name == "table":
            rows, caption = _table(child)
            lines.end(2)
            lines.block(caption)
            lines.end(1)
            lines.block(_aligned(rows))
            lines.end(2)
        elif name == "blockquote" or name == "dd":
            lines.end(2 if name in SPACED else 1)
            lines.block(_flow(child), "  ", "  ")
            lines.end(2 if name in SPACED else 1)
        elif name in BLOCK:
            gap = 2 if name in SPACED else 1
            lines.end(gap)
            _render(child, lines, depth, pre or name == "pre")
            lines.end(gap)
        else:
            _render(child, lines, depth, pre)


def visible(tree: Node) -> str:
    """All visible text of a parsed page, however deep its elements nest."""
    deep, todo = 0, [(tree, 1)]
    styled = False
    while todo:
        node, depth = todo.pop()
        deep, styled = max(deep, depth), styled or node.name == "style"
        todo += [(c, depth + 1) for c in node.children if isinstance(c, Node)]
    mark(tree, styled)
    before = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(before, 1000 + 6 * deep))  # frames of Python functions are on the heap
        lines = _flow(tree)
    finally:
        sys.setrecursionlimit(before)
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def render(html: str | None) -> str:
    """All visible text of a page. Null and empty pages give an empty string."""
    return visible(parse(html)) if html else ""


def language_of(tree: Node) -> str:
    """The primary subtag of the lang or else xml:lang attribute on the html element of a parsed page, else empty."""
    attrs = tree.attributes()
    return (attrs.get("lang") or attrs.get("xml:lang") or "").strip().lower().replace("_", "-").split("-")[0]


def declared_language(html: str | None) -> str:
    """What ``language_of`` finds, wherever on the page the html tag starts; tags in comments and scripts do not count."""
    return language_of(parse(html)) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_lines for every row of ``pages``.

    Null html gives an empty text. Pages are independent: no shuffle, memory for one Arrow
    batch of pages. Repeated rows stay repeated and other columns are ignored.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": [render(x) for x in pdf["html"]]})

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    out = rows.mapInPandas(batches, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
