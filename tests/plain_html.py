"""HTML extraction over a tree of objects: what the extraction over node tables is tested against."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from folio.functions.text import PY_WHITE
from folio.operators.htmltree import HEADINGS, Document, Element
from folio.operators.schema import block
from folio.operators.selectors import matches, query_all, query_one

#: Elements that are blocks, and elements that are sections.
BLOCK_TAGS = frozenset("p pre ul ol table blockquote dl emu-alg emu-grammar emu-code emu-note emu-example emu-equation emu-table".split())
SECTION_TAGS = frozenset("section emu-intro emu-clause emu-annex".split())
CODE_TAGS = frozenset("pre emu-alg emu-grammar emu-code emu-equation".split())
NOTE_TAGS = frozenset("blockquote emu-note emu-example".split())
#: Classes that settle normativity unless rules say otherwise.
INFORMATIVE = ("note", "informative", "non-normative", "warning", "issue", "ednote", "advisement")
EXAMPLE = ("example", "examples")
NORMATIVE = ("normative",)

#: White space but for single blanks, which stay as they are.
_SPACES = re.compile(f"[{PY_WHITE.replace(' ', '')}][{PY_WHITE}]*| [{PY_WHITE}]+")
_PRODUCTION = re.compile(rf"^[{PY_WHITE}]*([^:]+)::=[{PY_WHITE}]*(.+)$")


def clean(text: str | None) -> str:
    return _SPACES.sub(" ", text or "").strip(" ")


@dataclass
class Note:
    """What the walk knows of an element."""

    path: str
    norm: str | None


@dataclass
class Page:
    """A page under extraction."""

    document: Document
    rules: dict
    url: str
    authority: str
    notes: dict[int, Note] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.base = self.url.split("#", 1)[0]
        self.kinds = {}
        for kind, default in (("normative", NORMATIVE), ("informative", INFORMATIVE), ("example", EXAMPLE)):
            own = self.rules.get(kind)
            self.kinds |= dict.fromkeys(default if own is None else own, kind)
        for selector in self.rules.get("prune") or ():
            for node in query_all(self.document.root, selector):
                node.remove()
        self.body = self.document.within()
        self.survey()

    def survey(self) -> None:
        """Notes paths below the body and inherited normativity, top down."""
        if self.body is None:
            return
        self.notes[id(self.body)] = Note("", None)
        stack = [self.body]
        while stack:
            parent = stack.pop()
            above, seen = self.notes[id(parent)], {}
            for child in parent.elements():
                seen[child.tag] = seen.get(child.tag, 0) + 1
                step = f"{child.tag}:nth-of-type({seen[child.tag]})"
                own = next((self.kinds[c] for c in child.classes if c in self.kinds), None)
                self.notes[id(child)] = Note(f"{above.path} > {step}" if above.path else step, own or above.norm)
                stack.append(child)

    def source(self, node: Element | None, fragment: str | None) -> dict:
        note = self.notes.get(id(node)) if node is not None else None
        return {"url": f"{self.base}#{fragment}" if fragment else self.base, "fragment": fragment or None, "path": note.path if note else None}

    def is_any(self, node: Element, rule: str) -> bool:
        return any(matches(node, s) for s in self.rules.get(rule) or ())

    def is_block(self, node: Element) -> bool:
        return node.tag in BLOCK_TAGS or self.is_any(node, "algorithm") or self.is_any(node, "grammar")

    def parts(self, container: Element):
        """Headings and top-level blocks below an element, in order: (is it a heading, element)."""
        stack = [(c, False) for c in container.elements()[::-1]]
        while stack:
            node, hidden = stack.pop()
            if node.tag in HEADINGS:
                yield True, node
            elif not hidden and self.is_block(node):
                yield False, node
            hidden = hidden or node.tag in BLOCK_TAGS or node.tag in SECTION_TAGS
            stack.extend((c, hidden) for c in node.elements()[::-1])

    def blocks(self, container: Element | None) -> list[dict]:
        """The blocks of one section; headings that algorithms or grammars claim count as blocks too."""
        found = []
        if container is not None:
            stack = [(c, False) for c in container.elements()[::-1]]
            while stack:
                node, hidden = stack.pop()
                if not hidden and self.is_block(node):
                    found.append(self.block(node))
                hidden = hidden or node.tag in BLOCK_TAGS or node.tag in SECTION_TAGS
                stack.extend((c, hidden) for c in node.elements()[::-1])
        return [b for b in found if b]

    def by_headings(self, root: Element | None) -> list[dict]:
        sections: list[dict] = []
        if root is None:
            return sections
        for heading, node in self.parts(root):
            if heading:
                sections.append(self.section(node, node, node, []))
            elif sections and (made := self.block(node)):
                sections[-1]["blocks"].append(made)
        return sections or [self.whole()]

    def by_selector(self, root: Element | None, selector: str) -> list[dict]:
        sections = []
        for node in query_all(root, selector) if root is not None else []:
            heading = next((n for n in node.walk() if n.tag in HEADINGS), None)
            blocks = self.blocks(node)
            if blocks or heading is not None and clean(heading.text()):
                sections.append(self.section(node, heading, heading or node, blocks))
        return sections or self.by_headings(self.body)

    def whole(self) -> dict:
        return {"id": None, "heading": self.document.title or "Document", "level": 1, "blocks": self.blocks(self.body), "source": self.source(self.body, None)}

    def section(self, container: Element, heading: Element | None, at: Element, blocks: list[dict]) -> dict:
        name = self.section_id(container, heading)
        text = clean(heading.text()) if heading is not None else ""
        return {"id": name, "heading": text or "Untitled", "level": int(heading.tag[1]) if heading is not None else 1, "blocks": blocks, "source": self.source(at, name)}

    @staticmethod
    def anchor(node: Element | None) -> str | None:
        """The id or name of the first descendant that has one."""
        found = query_one(node, "[id], a[name]") if node is not None else None
        return None if found is None else found.get("id") if found.get("id") is not None and found.get("id") != "" else found.get("name")

    def section_id(self, container: Element, heading: Element | None) -> str | None:
        own = container.id or (heading.id if heading is not None else "")
        if own:
            return own
        for place in (heading, container):
            if place is not None and query_one(place, "[id], a[name]") is not None:
                return self.anchor(place)
        link = query_one(heading, "a[href^='#']") if heading is not None else None
        return link.get("href").removeprefix("#") if link is not None else None

    # Blocks.

    def block(self, node: Element) -> dict | None:
        if self.is_any(node, "algorithm"):
            made = self.algorithm(node)
        elif self.is_any(node, "grammar"):
            made = self.grammar(node)
        else:
            made = self.plain(node)
        if made is None:
            return None
        name = node.id or self.anchor(node)
        note = self.notes.get(id(node))
        norm = (note.norm if note else None) or ("normative" if self.authority == "normative" else "informative")
        return block(id=name, normativity=norm, source=self.source(node, name), links=self.links(node), **made)

    @staticmethod
    def links(node: Element) -> list[dict]:
        hrefs = [(a, a.get("href")) for a in node.walk() if a.tag == "a" and a.get("href")]
        return [{"text": clean(a.text()) or h, "href": h, "resolved_id": h[1:] if h.startswith("#") else None} for a, h in hrefs]

    @staticmethod
    def plain(node: Element) -> dict | None:
        tag = node.tag
        if tag == "p" or tag in NOTE_TAGS:
            text = clean(node.text())
            return {"type": "paragraph" if tag == "p" else "note", "text": text} if text else None
        if tag in CODE_TAGS:
            text = re.sub("\n{3,}", "\n\n", node.text()).rstrip(PY_WHITE_SET)
            return {"type": "code", "text": text} if text else None
        if tag in ("ul", "ol"):
            items = [t for t in (clean(c.text()) for c in node.elements() if c.tag == "li") if t]
            return {"type": "list", "ordered": tag == "ol", "items": items} if items else None
        if tag == "dl":
            pairs = []
            for c in node.elements():
                if c.tag == "dt":
                    pairs.append([clean(c.text()), []])
                elif c.tag == "dd":
                    if not pairs:
                        pairs.append(["", []])
                    pairs[-1][1].append(clean(c.text()))
            made = [{"term": term, "definition": " ".join(d for d in definitions if d)} for term, definitions in pairs]
            return {"type": "definitionList", "definitions": made} if made else None
        if tag in ("table", "emu-table"):
            return table(node)
        return None

    def algorithm(self, node: Element) -> dict | None:
        items = node if node.tag == "ol" else next((n for n in node.walk() if n.tag == "ol"), None)
        if items is None:
            return None
        texts = [clean(c.text()) for c in items.elements() if c.tag == "li"]
        steps = [{"step_id": str(i), "text": t} for i, t in enumerate(texts, 1) if t]
        if not steps:
            return None
        label = node.get("data-algorithm") or node.get("aria-label")
        if not label:
            before = self.heading_before(node)
            label = before.text() if before is not None else None
        return {"type": "algorithm", "title": None if label is None else clean(label), "steps": steps}

    def heading_before(self, node: Element) -> Element | None:
        """The nearest heading among earlier siblings, then among those of its ancestors up to the body."""
        while node.parent is not None:
            earlier = []
            for sibling in node.parent.elements():
                if sibling is node:
                    break
                earlier.append(sibling)
            found = next((n for n in reversed(earlier) if n.tag in HEADINGS), None)
            if found is not None or node.parent is self.body:
                return found
            node = node.parent
        return None

    @staticmethod
    def grammar(node: Element) -> dict | None:
        lines = (_PRODUCTION.match(line) for line in node.text().replace("\r\n", "\n").strip(PY_WHITE_SET).split("\n"))
        made = [{"lhs": clean(m[1]), "rhs": clean(m[2])} for m in lines if m]
        return {"type": "grammar", "productions": made} if made else None

    def extract(self) -> dict:
        root = query_one(self.document.root, self.rules["root"]) if self.rules.get("root") else None
        root = root or self.body
        pre = next((n for n in root.walk() if n.tag == "pre"), None) if self.rules.get("single_pre") and root is not None else None
        if pre is not None and clean(pre.text()):
            made = self.block(pre)
            sections = [{"id": pre.id or None, "heading": self.document.title or "Document", "level": 1, "blocks": [made] if made else [], "source": self.source(pre, pre.id or None)}]
        elif not self.rules.get("single_pre") and self.rules.get("sections"):
            sections = self.by_selector(root, self.rules["sections"])
        else:
            sections = self.by_headings(root)
        return {"title": self.document.title or (sections[0]["heading"] if sections else "Untitled"), "sections": numbered(sections), "warnings": None}


PY_WHITE_SET = "".join(chr(i) for i in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))


def table(node: Element) -> dict | None:
    inner = list(node.walk())
    all_rows = [n for n in inner if n.tag == "tr"]

    def cells(of: Element, tags=("th", "td")) -> list[str]:
        return [clean(n.text()) for n in of.walk() if n.tag in tags]

    head = next((n for n in inner if n.tag == "thead"), None)
    headers = cells(head) if head is not None else cells(all_rows[0], ("th",)) if all_rows else []
    headers = [h for h in headers if h]
    rows = [n for n in all_rows if any(up.tag == "tbody" for up in n.ancestors())] or all_rows
    if headers and rows and cells(rows[0], ("th",)):
        rows = rows[1:]
    rows = [c for c in map(cells, rows) if c]
    return {"type": "table", "headers": headers, "rows": rows} if headers or rows else None


def numbered(sections: list[dict]) -> list[dict]:
    """Sections and blocks with their ordinals."""
    return [{**s, "ordinal": i, "blocks": [{**b, "ordinal": j} for j, b in enumerate(s["blocks"])]} for i, s in enumerate(sections)]


def extract_html(text: str | None, url: str, rules: dict, authority: str = "informative") -> dict:
    """One page: ``title``, ``sections`` and ``warnings``."""
    return Page(Document(text or ""), rules, url or "", authority or "informative").extract()
