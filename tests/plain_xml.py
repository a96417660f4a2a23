"""XML extraction over a tree of objects: what the extraction over element tables is tested against."""

from __future__ import annotations

import re
import xml.parsers.expat
from collections.abc import Iterator

from folio.functions.text import PY_WHITE
from folio.operators.schema import block

#: White space but for single blanks, which stay as they are.
_SPACES = re.compile(f"[{PY_WHITE.replace(' ', '')}][{PY_WHITE}]*| [{PY_WHITE}]+")

#: Attributes that describe a schema, an element and an attribute, in order.
SCHEMA_ATTRIBUTES = ("targetNamespace", "elementFormDefault", "attributeFormDefault", "version", "id")
ELEMENT_ATTRIBUTES = ("type", "substitutionGroup", "minOccurs", "maxOccurs", "abstract", "nillable", "default", "fixed", "form", "block", "final")
ATTRIBUTE_ATTRIBUTES = ("type", "use", "default", "fixed", "form")
#: The kinds of definitions, the ids and headings of their sections and the ids of their blocks, in order.
KINDS = (
    ("element", "elements", "Elements", "element-definitions"),
    ("attribute", "attributes", "Attributes", "attribute-definitions"),
    ("attributeGroup", "attribute-groups", "Attribute Groups", "attribute-group-definitions"),
    ("group", "groups", "Groups", "group-definitions"),
    ("complexType", "complex-types", "Complex Types", "complex-type-definitions"),
    ("simpleType", "simple-types", "Simple Types", "simple-type-definitions"),
)
LINES, NAMES, ASSERTIONS, DOCUMENTATION = 2000, 20, 10, 240


def clean(text: str | None) -> str:
    return _SPACES.sub(" ", text or "").strip(" ")


def numbered(sections: list[dict]) -> list[dict]:
    """Sections and blocks with their ordinals."""
    return [{**s, "ordinal": i, "blocks": [{**b, "ordinal": j} for j, b in enumerate(s["blocks"])]} for i, s in enumerate(sections)]


class Node:
    """An element: qualified name, attributes, own text, and children grouped by name at the first one's place."""

    __slots__ = ("name", "attributes", "text", "groups")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.text = name, attributes, ""
        self.groups: dict[str, list[Node]] = {}

    @property
    def local(self) -> str:
        return self.name.rsplit(":", 1)[-1]

    def children(self) -> Iterator[Node]:
        for group in self.groups.values():
            yield from group

    def all(self, local: str) -> list[Node]:
        return [n for n in self.children() if n.local == local]

    def first(self, local: str) -> Node | None:
        return next((n for n in self.children() if n.local == local), None)

    def deep(self, local: str) -> Iterator[Node]:
        """Descendants of this name, parents before children."""
        stack = list(self.children())[::-1]
        while stack:
            node = stack.pop()
            if node.local == local:
                yield node
            stack.extend(list(node.children())[::-1])

    def get(self, name: str) -> str:
        return self.attributes.get(name) or ""


def parse(text: str) -> Node | None:
    """The root element; raises on malformed text, and on entity declarations."""
    parser = xml.parsers.expat.ParserCreate()
    parser.buffer_text = True
    root: list[Node] = []
    stack: list[Node] = []

    def start(name, attributes):
        node = Node(name, attributes)
        if stack:
            stack[-1].groups.setdefault(name, []).append(node)
        else:
            root.append(node)
        stack.append(node)

    def data(value):
        if stack:
            stack[-1].text += value

    def refuse(*_):
        raise ValueError("entity declarations are not expanded")

    parser.StartElementHandler, parser.CharacterDataHandler = start, data
    parser.EndElementHandler = lambda _: stack.pop()
    parser.EntityDeclHandler = refuse
    parser.Parse(text.lstrip("\ufeff"), True)
    return root[0] if root else None


def summary(names: list[str], limit: int = NAMES) -> str:
    more = f", ... (+{len(names) - limit} more)" if len(names) > limit else ""
    return ", ".join(names[:limit]) + more


def shortened(text: str, limit: int = DOCUMENTATION) -> str:
    return text if len(text) <= limit else text[: limit - 3] + "..."


def documentation(node: Node) -> str:
    texts = [clean(" ".join(_texts(d))) for a in node.all("annotation") for d in a.all("documentation")]
    return clean(" ".join(t for t in texts if t))


def _texts(node: Node) -> Iterator[str]:
    stack = [node]
    while stack:
        node = stack.pop()
        if node.text:
            yield node.text
        stack.extend(list(node.children())[::-1])


def described(pairs: list[tuple[str, str | None]]) -> str:
    return clean("; ".join(f"{k}={v}" for k, v in pairs if v is not None))


def listed(name: str, entries: list[str], limit: int = NAMES) -> list[tuple[str, str]]:
    return [(name, f"[{summary(entries, limit)}]")] if entries else []


def brief(node: Node, names: tuple[str, ...]) -> str:
    """An element or attribute inside a model, with some of its options."""
    options = ", ".join(f"{n}={node.get(n)}" for n in names if node.get(n))
    label = node.get("name") or node.get("ref") or "(anonymous)"
    return clean(f"{label} ({options})" if options else label)


def within(node: Node, local: str, names: tuple[str, ...]) -> list[str]:
    """What a content model holds of one name; what stands inside such a node is its own affair."""
    out, stack = [], list(node.children())[::-1]
    while stack:
        child = stack.pop()
        if child.local == local:
            out.append(brief(child, names))
        else:
            stack.extend(list(child.children())[::-1])
    return out


def options_of(node: Node) -> str:
    return ", ".join(f"{k}={v}" for k, v in node.attributes.items())


def facets(restriction: Node) -> list[str]:
    out = []
    for facet in restriction.children():
        if facet.local in ("annotation", "simpleType"):
            continue
        if list(facet.attributes) == ["value"]:
            out.append(clean(f"{facet.local}={facet.attributes['value']}"))
        else:
            out.append(clean(f"{facet.local}({options_of(facet)})" if facet.attributes else facet.local))
    return out


def assertions(node: Node) -> list[str]:
    return [clean(f"assert({options_of(a)})") if a.attributes else "assert" for a in node.deep("assert")]


def base_of(node: Node) -> str | None:
    """What a complex type extends or restricts."""
    ways = ((content, way) for content in ("complexContent", "simpleContent") for way in ("extension", "restriction"))
    steps = (holder.first(way) for content, way in ways if (holder := node.first(content)) is not None)
    return next((s.get("base") for s in steps if s is not None and s.get("base")), None)


def inline_type(parent: Node) -> str | None:
    """What an inline simple type is made from."""
    inner = parent.first("simpleType")
    if inner is None:
        return None
    made = ((inner.first(local), name, prefix) for local, name, prefix in (("restriction", "base", ""), ("list", "itemType", "list:"), ("union", "memberTypes", "union:")))
    return next((prefix + node.get(name) for node, name, prefix in made if node is not None and node.get(name)), "inline")


def attributes_of(node: Node, names: tuple[str, ...]) -> list[tuple[str, str | None]]:
    return [(n, node.attributes.get(n)) for n in names]


def definition(node: Node) -> str:
    """One definition as ``key=value`` pairs, by its kind."""
    elements = listed("elements", within(node, "element", ("type", "minOccurs", "maxOccurs")))
    attributes = listed("attributes", within(node, "attribute", ("type", "use")))
    pairs: list[tuple[str, str | None]] = []
    match node.local:
        case "element":
            # Only names without a prefix count as inline types.
            inline = next((n for n in ("complexType", "simpleType") if n in node.groups), None)
            pairs = [*attributes_of(node, ELEMENT_ATTRIBUTES), ("inlineType", inline), *elements, *attributes]
        case "attribute":
            pairs = attributes_of(node, ATTRIBUTE_ATTRIBUTES)
        case "attributeGroup":
            pairs = attributes
        case "group":
            pairs = elements
        case "complexType":
            pairs = [*attributes_of(node, ("mixed", "abstract", "block", "final")), ("base", base_of(node)), *elements, *attributes, *listed("assertions", assertions(node), ASSERTIONS)]
        case _:
            pairs = attributes_of(node, ("final",))
            for local, name, key in (("restriction", "base", "base"), ("list", "itemType", "listOf"), ("union", "memberTypes", "unionOf")):
                if (way := node.first(local)) is not None:
                    pairs.append((key, way.get(name) or inline_type(way)))
                    pairs += listed("facets", facets(way)) if local == "restriction" else []
                    break
    doc = documentation(node)
    return described([*pairs, ("doc", shortened(doc) if doc else None)])


def label_of(node: Node) -> str:
    ref = node.get("ref") if node.local in ("element", "attribute", "group", "attributeGroup") else ""
    prefix = "ref:" if node.local in ("element", "attribute") else ""
    return clean(f"{node.local} {node.get('name') or (prefix + ref if ref else '(anonymous)')}")


def definition_section(name: str, heading: str, block_id: str, definitions: list[dict]) -> dict:
    return {"id": name, "heading": heading, "level": 1, "source": None, "blocks": [block(id=block_id, type="definitionList", definitions=definitions)]}


def schema_sections(root: Node) -> list[dict]:
    names = sorted((n for n in root.attributes if n in SCHEMA_ATTRIBUTES or n.startswith("xmlns")), key=lambda n: (n.lower(), n))
    about = [{"term": clean(n), "definition": clean(root.attributes[n])} for n in names]
    out = [definition_section("schema-metadata", "Schema Metadata", "schema-attributes", about)] if about else []
    for local, name, heading, block_id in KINDS:
        found = [{"term": label_of(n), "definition": definition(n)} for n in root.deep(local)]
        if found:
            out.append(definition_section(name, heading, block_id, found))
    return out


def lines_of(node: Node, path: str) -> Iterator[str]:
    """An element's attributes, then its children's lines, then its own text."""
    stack: list[tuple[Node, str] | str] = [(node, path)]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
            continue
        node, path = top
        for name, value in node.attributes.items():
            yield f"{path} @{name}: {value}"
        if text := clean(node.text):
            stack.append(f"{path}/#text: {text}")
        inner = [(child, f"{path}/{name}[{i}]" if len(group) > 1 else f"{path}/{name}") for name, group in node.groups.items() for i, child in enumerate(group)]
        stack.extend(inner[::-1])


def generic_sections(root: Node | None) -> list[dict]:
    items = []
    if root is not None:
        for line in lines_of(root, f"/{root.name}"):
            items.append(line)
            if len(items) == LINES:
                break
    return [{"id": None, "heading": root.name if root is not None else "document", "level": 1, "source": None, "blocks": [block(id="xml-lines", type="list", items=items)]}]


def extract_xml(text: str | None, url: str, title: str | None = None) -> dict:
    """One text: ``title``, ``sections`` and ``warnings``; what can't be parsed has a warning and no sections.

    Elements may nest to any depth.
    """
    try:
        root = parse(text or "") if text else None
    except (xml.parsers.expat.ExpatError, ValueError) as error:
        return {"title": title or url, "sections": [], "warnings": [f"XML parse failed: {error}"]}
    sections = schema_sections(root) if root is not None and root.local == "schema" else []
    return {"title": title or url, "sections": numbered(sections or generic_sections(root)), "warnings": []}
