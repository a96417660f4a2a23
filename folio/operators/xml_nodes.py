"""XML texts as flat tables of elements: what a parser in Python is needed for.

A text is parsed with expat; entities that it declares itself are not expanded.
Children of one qualified name are grouped at the first one's place; in that order
``pre`` is an element's place in the text, and its descendants are the places after
it up to ``end``.  ``nth`` and ``of`` number an element in its group.
"""

from __future__ import annotations

import xml.parsers.expat

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

ELEMENT = "struct<pre:int,end:int,parent:int,name:string,nth:int,of:int,attributes:array<struct<name:string,value:string>>,text:string>"
PARSED = f"struct<elements:array<{ELEMENT}>,error:string>"


def flat(text: str) -> list[tuple]:
    """The elements of a text, in the order of :data:`ELEMENT`; raises on malformed text, and on entity declarations."""
    parser = xml.parsers.expat.ParserCreate()
    parser.buffer_text, parser.ordered_attributes = True, True
    # Of each element its name, attributes, pieces of text, and children by name.
    roots: list[tuple] = []
    open_: list[tuple] = []

    def start(name, attributes):
        element = (name, attributes, [], {})
        if open_:
            open_[-1][3].setdefault(name, []).append(element)
        else:
            roots.append(element)
        open_.append(element)

    def data(value):
        if open_:
            open_[-1][2].append(value)

    def refuse(*_):
        raise ValueError("entity declarations are not expanded")

    parser.StartElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = start, data, refuse
    parser.EndElementHandler = lambda _: open_.pop()
    parser.Parse(text.lstrip("\ufeff"), True)

    out: list[list] = []
    stack: list[tuple] = [(r, -1, 0, 1) for r in roots[:1]]
    while stack:
        element, parent, nth, of = stack.pop()
        if element is None:  # all below the element at ``parent`` is out
            out[parent][1] = len(out)
            continue
        name, attributes, texts, groups = element
        pre = len(out)
        pairs = [{"name": n, "value": v} for n, v in zip(attributes[::2], attributes[1::2], strict=True)]
        out.append([pre, pre + 1, parent, name, nth, of, pairs, "".join(texts)])
        stack.append((None, pre, 0, 0))
        for group in reversed(groups.values()):
            stack.extend((child, pre, i, len(group)) for i, child in reversed(list(enumerate(group))))
    return out


def elements_of(text: Column) -> Column:
    """The elements of a text, or why it can't be parsed; an empty text has none, null gives null."""
    made = to_arrow_type(_parse_datatype_string(PARSED))
    names = [f.name for f in made.field("elements").type.value_type]

    def one(text: str | None) -> dict | None:
        if text is None:
            return None
        try:
            return {"elements": [dict(zip(names, row, strict=True)) for row in flat(text)] if text else [], "error": None}
        except (xml.parsers.expat.ExpatError, ValueError) as error:
            return {"elements": None, "error": f"XML parse failed: {error}"}

    @F.arrow_udf(PARSED)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], made)

    return run(text)
