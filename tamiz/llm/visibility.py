"""Which elements of a page show: presentational attributes, inline styles and the page's own style sheets.

``display: none`` takes an element away with all that it holds. ``visibility`` is inherited, and an inner
element may set it back. Style sheets count by importance, specificity and order. Selectors may
hold types, classes, ids, attributes, descendants and children; rules with other parts (pseudo-classes,
siblings) and blocks for other media than the screen are passed over.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from html import unescape

# Elements that are never shown.
UNSEEN = frozenset("head script style template title noscript iframe object embed audio video canvas datalist noembed noframes meta link base".split())
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?\s*(?=;|$)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BRACE = re.compile(r"[{}]")
_SCREEN = re.compile(r"@media\s+(?:only\s+)?(?:all|screen)", re.I)
_COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+|\[\s*[\w:-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\])*)", re.I)
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]")
_NUMBER = re.compile(r"&#0*([0-9]+)")


def entities(s: str) -> str:
    """Character references resolved; numbers of any length are fine, those beyond Unicode become U+FFFD."""
    if "&" not in s:
        return s
    return unescape(_NUMBER.sub(lambda m: f"&#{m[1]}" if len(m[1]) < 8 else "&#1114112", s) if "&#" in s else s)


class Node:
    """An element; children are nodes and strings. ``gone`` and ``veiled`` are set by ``mark``."""

    __slots__ = ("attrs", "children", "gone", "name", "veiled")

    def __init__(self, name: str, attrs: str = "", veiled: bool = False) -> None:
        self.name, self.attrs, self.children = name, attrs, []
        self.gone, self.veiled = False, veiled

    def attributes(self) -> dict[str, str]:
        if not self.attrs.strip(" /"):
            return {}
        return {m[1].lower(): entities(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTR.finditer(self.attrs)))}


@dataclass(frozen=True)
class Compound:
    """What one element must be: type (empty: any), id and class names, attribute values (None: any)."""

    type: str
    ids: frozenset[str]
    classes: frozenset[str]
    values: tuple[tuple[str, str | None], ...]

    def fits(self, node: Node, attrs: dict[str, str]) -> bool:
        if self.type and self.type != node.name:
            return False
        if not (self.ids or self.classes or self.values):
            return True
        if self.ids and not self.ids <= {attrs.get("id")}:
            return False
        if self.classes and not self.classes <= set(attrs.get("class", "").split()):
            return False
        return all(k in attrs and v in (None, attrs[k]) for k, v in self.values)


@dataclass(frozen=True)
class Rule:
    """Compounds from the element outwards, each but the first with whether it must be the parent."""

    steps: tuple[tuple[bool, Compound], ...]
    weight: tuple[int, int, int]
    declared: tuple[tuple[str, str, bool], ...]


def declarations(style: str) -> tuple[tuple[str, str, bool], ...]:
    """property, value, whether it is important; of display and visibility only."""
    return tuple((m[1].lower(), m[2].lower(), bool(m[3])) for m in _DECLARATION.finditer(_COMMENT.sub(" ", style)))


def compound(text: str) -> Compound | None:
    m = _COMPOUND.fullmatch(text)
    if m is None or not text:
        return None
    parts = list(_PART.finditer(m[2]))
    names = {kind: frozenset(p[2] for p in parts if p[1] == kind) for kind in "#."}
    values = tuple((p[3].lower(), next((x for x in p.groups()[3:] if x is not None), None)) for p in parts if p[3])
    return Compound("" if m[1] in (None, "*") else m[1].lower(), names["#"], names["."], values)


def selector(text: str) -> tuple[tuple[tuple[bool, Compound], ...], tuple[int, int, int]] | None:
    """The steps of a selector and its specificity; None for parts that are not looked at."""
    steps: list[tuple[bool, Compound]] = []
    child = False
    for part in re.sub(r"\s*>\s*", " > ", text).split():
        if part == ">":
            child = True
            continue
        made = compound(part)
        if made is None:
            return None
        steps.append((child, made))
        child = False
    if not steps or child:
        return None
    # whether a step must be the parent of the next one belongs to the outer of the two
    outwards = [(False, steps[-1][1])] + [(steps[i + 1][0], steps[i][1]) for i in range(len(steps) - 2, -1, -1)]
    weight = tuple(sum(n(c) for _, c in steps) for n in (lambda c: len(c.ids), lambda c: len(c.classes) + len(c.values), lambda c: bool(c.type)))
    return tuple(outwards), weight


def rules_of(css: str) -> list[Rule]:
    """The rules of a style sheet that say something about display or visibility, in order."""
    css, preludes, at, out = _COMMENT.sub(" ", css), [], 0, []
    for m in _BRACE.finditer(css):
        if m[0] == "{":
            preludes.append(css[at : m.start()].rpartition(";")[2].strip())
        elif preludes:
            prelude = preludes.pop()
            said = declarations(css[at : m.start()]) if not prelude.startswith("@") and all(_SCREEN.fullmatch(p) for p in preludes) else ()
            for text in prelude.split(",") if said else ():
                found = selector(text)
                if found is not None:
                    out.append(Rule(*found, said))
        at = m.end()
    return out


class Sheet:
    """Rules by what their innermost step asks for, so that an element meets few of them."""

    def __init__(self, rules: list[Rule]) -> None:
        self.by: dict[str, list[tuple[int, Rule]]] = defaultdict(list)
        for at, rule in enumerate(rules):
            inner = rule.steps[0][1]
            key = next((f"#{x}" for x in inner.ids), None) or next((f".{x}" for x in inner.classes), None) or inner.type
            self.by[key].append((at, rule))

    def declared(self, path: tuple, attrs: dict[str, str]) -> list[tuple]:
        """(important, inline, specificity, order, property, value) of the rules that fit; ``path``: (node, attributes, path of the parent)."""
        keys = ["", path[0].name, f"#{attrs.get('id', '')}", *(f".{c}" for c in set(attrs.get("class", "").split()))]
        return [(important, False, rule.weight, at, name, value) for k in keys for at, rule in self.by.get(k, ()) if self.meets(rule, path) for name, value, important in rule.declared]

    @staticmethod
    def meets(rule: Rule, path: tuple) -> bool:
        """Whether the steps fit the element and some of those around it. Each step keeps the elements at which it may stand."""
        if not rule.steps[0][1].fits(path[0], path[1]):
            return False
        places = [path]
        for child, step in rule.steps[1:]:
            found, seen = [], set()
            for place in places:
                outer = place[2]
                while outer is not None and id(outer) not in seen:
                    seen.add(id(outer))
                    if step.fits(outer[0], outer[1]):
                        found.append(outer)
                    if child:
                        break
                    outer = outer[2]
            if not found:
                return False
            places = found
        return True


def _sheet(root: Node) -> Sheet | None:
    todo, rules = [root], []
    while todo:
        node = todo.pop()
        if node.name == "style":
            rules += rules_of("".join(c for c in node.children if isinstance(c, str)))
        todo += [c for c in reversed(node.children) if not isinstance(c, str) and (c.children or c.name == "style")]
    return Sheet(rules) if rules else None


def _plain(name: str, attrs: dict[str, str], opened: bool) -> str | None:
    """What the element is without any style: ``none`` if it does not show."""
    if "hidden" in attrs or (name == "dialog" and not opened) or (name == "input" and attrs.get("type", "").strip().lower() == "hidden"):
        return "none"
    return None


def mark(root: Node, styled: bool) -> None:
    """Set ``gone`` and ``veiled`` of every node. ``styled``: the page may have a style sheet."""
    sheet = _sheet(root) if styled else None
    todo: list[tuple[Node, bool, tuple | None]] = [(root, False, None)]
    while todo:
        node, veiled, around = todo.pop()
        if node.name in UNSEEN:
            node.gone = True
            continue
        path = None
        if node.attrs or sheet is not None or node.name == "dialog":
            low = node.attrs.lower()
            told = "hid" in low or "display" in low or "visib" in low or node.name == "dialog"
            attrs = node.attributes() if told or sheet is not None else {}
            path = (node, attrs, around)
            said = sheet.declared(path, attrs) if sheet is not None else []
            if told and "style" in attrs:
                said += [(important, True, (0, 0, 0), i, name, value) for i, (name, value, important) in enumerate(declarations(attrs["style"]))]
            display = max((s for s in said if s[4] == "display"), default=(None,))[-1] or _plain(node.name, attrs, "open" in attrs)
            visibility = max((s for s in said if s[4] == "visibility"), default=(None,))[-1]
            if visibility in ("hidden", "collapse"):
                veiled = True
            elif visibility in ("visible", "initial"):
                veiled = False
            if display == "none" or (visibility == "collapse" and node.name in ("tr", "thead", "tbody", "tfoot")):
                node.gone = True
                continue
        node.veiled = veiled
        inner = [c for c in node.children if not isinstance(c, str)]
        if node.name == "details" and "open" not in node.attributes():
            summary = next((c for c in inner if c.name == "summary"), None)
            node.children = [] if summary is None else [summary]
            inner = node.children
        todo += [(c, veiled, path) for c in inner]
