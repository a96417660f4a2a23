"""The part of CSS selectors that families use: type, class, id, attributes, descendants, children and lists."""

from __future__ import annotations

import re
from functools import lru_cache

from folio.operators.htmltree import Element

_PART = re.compile(r"(?P<type>[A-Za-z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|\[\s*(?P<name>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\]\s]+))\s*)?\]")


class _Compound:
    """Tests that one element must pass all."""

    def __init__(self, text: str):
        self.tests, at = [], 0
        while at < len(text):
            m = _PART.match(text, at)
            if not m:
                raise ValueError(f"not a selector: {text}")
            at = m.end()
            if m["type"]:
                if m["type"] != "*":
                    self.tests.append(("type", m["type"].lower(), "", ""))
            elif m["id"]:
                self.tests.append(("id", m["id"], "", ""))
            elif m["class"]:
                self.tests.append(("class", m["class"], "", ""))
            else:
                self.tests.append(("attribute", m["name"].lower(), m["op"] or "", m["a"] or m["b"] or m["c"] or ""))

    def sql(self, node: str) -> str:
        """The tests on a node of :mod:`folio.operators.html_nodes`, as SQL."""
        out = [f"{node}.tag IS NOT NULL"]
        for kind, name, op, value in self.tests:
            name, value = (x.replace("\\", "\\\\").replace("'", "\\'") for x in (name, value))
            own = f"try_element_at({node}.attributes, '{name}')"
            if kind == "attribute" and op in ("^=", "$=", "*=") and not value:
                out.append("false")
            elif kind == "attribute":
                test = {"": "{0} IS NOT NULL", "=": "{0} = '{1}'", "~=": "array_contains(split({0}, r'\\s+'), '{1}')", "|=": "({0} = '{1}' OR startswith({0}, '{1}-'))"}
                test |= {"^=": "startswith({0}, '{1}')", "$=": "endswith({0}, '{1}')", "*=": "contains({0}, '{1}')"}
                out.append(test[op].format(own, value))
            else:
                out.append({"type": f"{node}.tag = '{name}'", "id": f"{node}.id = '{name}'", "class": f"array_contains({node}.classes, '{name}')"}[kind])
        return " AND ".join(out)

    def __call__(self, node: Element) -> bool:
        for kind, name, op, value in self.tests:
            if kind == "type" and node.tag != name or kind == "id" and node.id != name or kind == "class" and name not in node.classes:
                return False
            if kind == "attribute":
                own = node.get(name)
                if own is None or op == "=" and own != value or op == "~=" and value not in own.split():
                    return False
                if op in ("^=", "$=", "*=") and not (value and (own.startswith(value) if op == "^=" else own.endswith(value) if op == "$=" else value in own)):
                    return False
                if op == "|=" and own != value and not own.startswith(value + "-"):
                    return False
        return True


@lru_cache(512)
def compiled(selector: str) -> tuple | None:
    """Alternatives, each a list of (combinator, compound) from right to left; None where it can't be read."""
    try:
        out = []
        for one in re.split(r",(?![^\[]*\])", selector):
            words = re.findall(r">|(?:\[[^\]]*\]|[^\s>])+", one)
            if not words or words[0] == ">" or words[-1] == ">":
                return None
            steps, child = [], False
            for word in words:
                if word == ">":
                    child = True
                else:
                    steps.append((">" if child else " ", _Compound(word)))
                    child = False
            out.append(steps[::-1])
        return tuple(out)
    except ValueError:
        return None


def _matches(node: Element, steps, at: int = 0) -> bool:
    combinator, compound = steps[at]
    if not compound(node):
        return False
    if at + 1 == len(steps):
        return True
    if combinator == ">":
        return node.parent is not None and _matches(node.parent, steps, at + 1)
    return any(_matches(up, steps, at + 1) for up in node.ancestors())


def matches(node: Element, selector: str) -> bool:
    """Whether an element matches; a selector that can't be read matches nothing."""
    return any(_matches(node, steps) for steps in compiled(selector) or ())


def query_all(root: Element, selector: str) -> list[Element]:
    """Matching elements below ``root``, in document order."""
    return [n for n in root.walk() if matches(n, selector)]


def query_one(root: Element, selector: str) -> Element | None:
    return next((n for n in root.walk() if matches(n, selector)), None)


def sql_matches(selectors: tuple[str, ...], node: str, at, fresh) -> str:
    """Whether a node matches one of the selectors, as SQL; ``at`` gives the node at a place, ``fresh`` a name for a variable."""

    def test(x: str, steps, i: int) -> str:
        combinator, compound = steps[i]
        own = compound.sql(x)
        if i + 1 == len(steps):
            return own
        if combinator == ">":
            return f"{own} AND {test(at(f'{x}.parent'), steps, i + 1)}"
        a = fresh()
        return f"{own} AND exists({x}.above, {a} -> {test(at(a), steps, i + 1)})"

    tests = [f"({test(node, steps, 0)})" for selector in selectors for steps in compiled(selector) or ()]
    return f"coalesce({' OR '.join(tests)}, false)" if tests else "false"
