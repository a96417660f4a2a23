"""A small HTML tree: tags and text in, elements with parent, order and path out.

Follows the tree-construction rules that real pages lean on: implied html, head,
body and tbody, elements that close others by opening, scopes of tables, void
and raw-text elements, entities, and formatting elements that are opened again
in the next block.
"""

from __future__ import annotations

import html as entities
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset(("title", "textarea"))
HEAD_ONLY = frozenset("base basefont bgsound link meta title script style noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Opening one of these ends an open paragraph.
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre search section summary table ul dd dt li listing xmp plaintext".split()
)
SPECIAL = CLOSES_P | frozenset("body html head td th tr tbody thead tfoot caption colgroup button applet marquee object template select iframe".split())
TABLE_PARTS = frozenset("tbody thead tfoot tr td th caption colgroup col".split())

_TAG = re.compile(r"<(?:!--(.*?)(?:-->|$)|!\[CDATA\[(.*?)(?:\]\]>|$)|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"'<]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)


class Element:
    __slots__ = ("tag", "attributes", "parent", "children", "removed")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, parent: Element | None = None):
        self.tag, self.attributes, self.parent, self.children, self.removed = tag, attributes or {}, parent, [], False

    def append(self, child: Element | str) -> None:
        if isinstance(child, str):
            if self.children and isinstance(self.children[-1], str):
                self.children[-1] += child
                return
        else:
            child.parent = self
        self.children.append(child)

    def get(self, name: str) -> str | None:
        return self.attributes.get(name)

    @property
    def id(self) -> str:
        return self.attributes.get("id") or ""

    @property
    def classes(self) -> list[str]:
        return (self.attributes.get("class") or "").split()

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self):
        """All elements below, in document order."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements()[::-1])

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(node.children[::-1])
        return "".join(out)

    def ancestors(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class Builder:
    def __init__(self) -> None:
        self.root = Element("#document")
        self.html = self.head = self.body = None
        self.stack: list[Element] = []
        #: Formatting elements to open again in the next block.
        self.active: list[Element] = []
        self.after_pre = False

    @property
    def top(self) -> Element:
        return self.stack[-1]

    def need_html(self) -> None:
        if self.html is None:
            self.html = Element("html")
            self.root.append(self.html)
            self.stack = [self.html]

    def need_head(self) -> None:
        self.need_html()
        if self.head is None and self.body is None:
            self.head = Element("head")
            self.html.append(self.head)
            self.stack = [self.html, self.head]

    def need_body(self) -> None:
        self.need_html()
        if self.body is None:
            if self.head is None:
                self.head = Element("head")
                self.html.append(self.head)
            self.body = Element("body")
            self.html.append(self.body)
            self.stack = [self.html, self.body]

    def in_scope(self, tags, stops=frozenset(("table", "td", "th", "caption", "html", "button", "object", "template", "applet", "marquee"))) -> bool:
        for node in reversed(self.stack):
            if node.tag in tags:
                return True
            if node.tag in stops:
                return False
        return False

    def pop_to(self, tags) -> None:
        while len(self.stack) > 2:
            if self.stack.pop().tag in tags:
                return

    def close_p(self) -> None:
        if self.in_scope(("p",)):
            self.pop_to(("p",))

    def reopen(self) -> None:
        """Formatting elements that were cut off by the end of a block go on."""
        at = len(self.active)
        while at and self.active[at - 1] not in self.stack:
            at -= 1
        for i in range(at, len(self.active)):
            again = Element(self.active[i].tag, dict(self.active[i].attributes))
            self.place(again)
            self.stack.append(again)
            self.active[i] = again

    def place(self, child: Element | str) -> None:
        """Appends, but before the table what may not stand right inside it."""
        top = self.top
        if top.tag in ("table", "tbody", "thead", "tfoot", "tr") and not (isinstance(child, Element) and child.tag in TABLE_PARTS | {"script", "style", "template"}):
            table = next(n for n in reversed(self.stack) if n.tag == "table") if any(n.tag == "table" for n in self.stack) else None
            if table is not None and table.parent is not None:
                parent = table.parent
                at = next(i for i, c in enumerate(parent.children) if c is table)
                if isinstance(child, str):
                    if at and isinstance(parent.children[at - 1], str):
                        parent.children[at - 1] += child
                    else:
                        parent.children.insert(at, child)
                else:
                    child.parent = parent
                    parent.children.insert(at, child)
                return
        top.append(child)

    def text(self, text: str) -> None:
        if self.after_pre and text.startswith("\n"):
            text = text[1:]
        self.after_pre = False
        if not text:
            return
        if self.body is None:
            blank = text.lstrip("\t\n\f\r ")
            if not blank:
                if self.stack and self.top.tag not in ("html", "head"):
                    self.top.append(text)
                return
            text = text if self.head is None else blank
            text = blank
            self.need_body()
        if self.top.tag in ("table", "tbody", "thead", "tfoot", "tr") and not text.strip("\t\n\f\r "):
            self.top.append(text)
            return
        self.reopen()
        self.place(text)

    def table_context(self, tag: str) -> bool:
        """Makes room for a part of a table; false where there is no table for it."""
        if not self.in_scope(("table",), frozenset(("html", "template"))):
            return False
        if tag in ("td", "th"):
            while self.top.tag not in ("tr", "tbody", "thead", "tfoot", "table"):
                self.stack.pop()
            if self.top.tag == "table":
                self.push(Element("tbody"))
            if self.top.tag != "tr":
                self.push(Element("tr"))
        elif tag == "tr":
            while self.top.tag not in ("tbody", "thead", "tfoot", "table"):
                self.stack.pop()
            if self.top.tag == "table":
                self.push(Element("tbody"))
        else:
            while self.top.tag != "table":
                self.stack.pop()
            if tag == "col":
                self.push(Element("colgroup"))
        return True

    def push(self, node: Element) -> None:
        self.place(node)
        self.stack.append(node)

    def open(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        self.after_pre = False
        if tag == "html":
            self.need_html()
            for k, v in attributes.items():
                self.html.attributes.setdefault(k, v)
            return
        if tag == "head":
            if self.head is None and self.body is None:
                self.need_head()
                self.head.attributes.update(attributes)
            return
        if tag == "body":
            self.need_body()
            for k, v in attributes.items():
                self.body.attributes.setdefault(k, v)
            return
        if self.body is None:
            if tag in HEAD_ONLY:
                self.need_head()
            else:
                self.need_body()
        if tag in TABLE_PARTS:
            if not self.table_context(tag):
                return
        elif tag == "table":
            if self.top.tag in ("table", "tbody", "thead", "tfoot", "tr"):
                self.pop_to(("table",))
            self.close_p()
        elif tag in CLOSES_P:
            if tag == "li":
                for node in reversed(self.stack):
                    if node.tag == "li":
                        self.pop_to(("li",))
                        break
                    if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                        break
            elif tag in ("dd", "dt"):
                for node in reversed(self.stack):
                    if node.tag in ("dd", "dt"):
                        self.pop_to(("dd", "dt"))
                        break
                    if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                        break
            self.close_p()
            if tag in HEADINGS and self.top.tag in HEADINGS:
                self.stack.pop()
        elif tag == "option" and self.top.tag == "option":
            self.stack.pop()
        elif tag == "a" and any(n.tag == "a" for n in self.active):
            self.close("a")
        if tag not in CLOSES_P and tag not in TABLE_PARTS and self.body is not None and tag not in HEAD_ONLY:
            self.reopen()
        node = Element(tag, attributes)
        self.place(node)
        if tag in VOID:
            return
        self.stack.append(node)
        if tag in FORMATTING:
            self.active.append(node)
        self.after_pre = tag in ("pre", "listing", "textarea")

    def close(self, tag: str) -> None:
        self.after_pre = False
        if tag in ("html", "body", "head") or not self.stack:
            if tag == "head" and self.head is not None and self.body is None:
                self.stack = [self.html]
            return
        if tag == "p" and not self.in_scope(("p",)):
            self.need_body()
            self.place(Element("p"))
            return
        if tag == "br":
            self.open("br", {}, False)
            return
        if tag in FORMATTING:
            found = next((n for n in reversed(self.active) if n.tag == tag), None)
            if found is None:
                return
            self.active.remove(found)
            if found not in self.stack:
                return
            at = self.stack.index(found)
            if any(n.tag in SPECIAL for n in self.stack[at + 1 :]):
                # The block stays open; what follows in it is no longer formatted.
                self.stack.pop(at)
                return
            del self.stack[at:]
            return
        if tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.pop_to(HEADINGS)
            return
        for i in range(len(self.stack) - 1, -1, -1):
            node = self.stack[i]
            if node.tag == tag:
                if node in (self.html, self.body):
                    return
                del self.stack[i:]
                if not self.stack:
                    self.stack = [self.html]
                return
            if node.tag in SPECIAL and tag not in SPECIAL:
                return
            if node.tag in ("td", "th", "caption", "table") and tag not in TABLE_PARTS and tag != "table":
                return


def attributes_of(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


class Document:
    """A parsed page: ``root``, ``body`` and ``title``."""

    def __init__(self, text: str):
        self.root, self.body = parse(text or "")

    @property
    def title(self) -> str:
        """The text of the first ``title`` as it stands, empty without one."""
        node = next((n for n in self.root.walk() if n.tag == "title"), None)
        return node.text() if node else ""

    def within(self) -> Element | None:
        """The body if it is still there, else the first element."""
        body = next((n for n in self.root.walk() if n.tag == "body"), None)
        return body or next(iter(self.root.elements()), None)


def parse(text: str) -> tuple[Element, Element]:
    build = Builder()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    at, n = 0, len(text)
    while at < n:
        start = text.find("<", at)
        if start < 0:
            build.text(entities.unescape(text[at:]))
            break
        match = _TAG.match(text, start)
        if match is None:
            # A lone angle bracket is text.
            build.text(entities.unescape(text[at : start + 1]))
            at = start + 1
            continue
        if start > at:
            build.text(entities.unescape(text[at:start]))
        at = match.end()
        tag = (match[4] or "").lower()
        if match[2] is not None:
            build.text(match[2])
        elif tag and match[3]:
            build.close(tag)
        elif tag:
            build.open(tag, attributes_of(match[5]), match[5].rstrip().endswith("/"))
            if tag in RAW or tag in RCDATA:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                body = text[at : end.start() if end else n]
                if body and build.stack and build.top.tag == tag:
                    build.top.append(entities.unescape(body) if tag in RCDATA else body)
                at = end.end() if end else n
                if build.stack and build.top.tag == tag:
                    build.stack.pop()
                build.after_pre = False
    build.need_body()
    return build.root, build.body
