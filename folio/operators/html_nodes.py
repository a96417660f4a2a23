"""HTML pages as flat tables of nodes: the one thing that a parser in Python is needed for.

A page becomes an array of nodes in document order.  ``pre`` is a node's place
there, its descendants are the places after it up to ``end``; ``above`` lists its
ancestors from the top.  Elements have a ``tag``, texts a ``text``; ``nth`` counts an
element among its siblings of one tag, ``after`` is the place of the last heading
among the siblings before a node, ``hider`` that of the nearest block or section
above it (-1 for none), and ``in_tbody`` marks rows somewhere below a ``tbody``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from folio.operators.htmltree import HEADINGS, Element, parse

NODE = "struct<pre:int,end:int,parent:int,above:array<int>,tag:string,text:string,id:string,classes:array<string>,attributes:map<string,string>,nth:int,after:int,hider:int,in_tbody:boolean>"
NODES = f"array<{NODE}>"

#: Elements that are blocks, and elements that are sections.
BLOCK_TAGS = frozenset("p pre ul ol table blockquote dl emu-alg emu-grammar emu-code emu-note emu-example emu-equation emu-table".split())
SECTION_TAGS = frozenset("section emu-intro emu-clause emu-annex".split())
_HIDERS = BLOCK_TAGS | SECTION_TAGS


def flat(root: Element) -> list[tuple]:
    """The nodes below ``root``, in the order of :data:`NODE`."""
    out: list[list] = []
    # Of each element that is open how many children of each tag it had, and its last heading.
    stack: list[tuple] = [(child, -1, (), counted, -1, False) for counted in [{}] for child in root.children[::-1]]
    while stack:
        node, parent, above, counted, hider, in_tbody = stack.pop()
        if node is None:  # all below the element at ``parent`` is out
            out[parent][1] = len(out)
            continue
        pre, after = len(out), counted.get(None)
        if isinstance(node, str):
            out.append([pre, pre + 1, parent, above, None, node, None, (), (), None, after, hider, False])
            continue
        tag = node.tag
        counted[tag] = nth = counted.get(tag, 0) + 1
        if tag in HEADINGS:
            counted[None] = pre
        out.append([pre, pre + 1, parent, above, tag, None, node.id or None, node.classes, tuple(node.attributes.items()), nth, after, hider, in_tbody and tag == "tr"])
        if node.children:
            stack.append((None, pre, (), None, -1, False))
            below, counted, hider, in_tbody = (*above, pre), {}, pre if tag in _HIDERS else hider, in_tbody or tag == "tbody"
            stack.extend([(child, pre, below, counted, hider, in_tbody) for child in node.children[::-1]])
    return out


def nested(lists, value_type: pa.DataType) -> pa.ListArray:
    ends, values = [0], []
    for x in lists:
        values.extend(x)
        ends.append(len(values))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, value_type))


def tables(pages: pa.Array, node: pa.StructType) -> pa.Array:
    """The nodes of each page as Arrow structs; null for null."""
    rows, ends, missing = [], [0], []
    for page in pages.to_pylist():
        rows += flat(parse(page)[0]) if page is not None else []
        ends.append(len(rows))
        missing.append(page is None)
    columns = list(zip(*rows, strict=True)) or [()] * 13
    names = nested([[k for k, _ in x] for x in columns[8]], pa.string())
    values = nested([[v for _, v in x] for x in columns[8]], pa.string())
    made = [
        *[pa.array(columns[i], pa.int32()) for i in range(3)], nested(columns[3], pa.int32()), *[pa.array(columns[i], pa.string()) for i in (4, 5, 6)], nested(columns[7], pa.string()),
        pa.MapArray.from_arrays(names.offsets, names.values, values.values), *[pa.array(columns[i], pa.int32()) for i in (9, 10, 11)], pa.array(columns[12], pa.bool_()),
    ]
    struct = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(made, node, strict=True)], fields=list(node))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct, mask=pa.array(missing, pa.bool_()))


#: Characters of pages from which on a batch of nodes is full.
BATCH = 1 << 18


def nodes_of(pages: DataFrame) -> DataFrame:
    """``own`` and ``nodes`` of pages with ``own`` and ``text``; nodes are many times their text, so a batch holds those of a few pages only."""
    node = to_arrow_type(_parse_datatype_string(NODE))

    def run(batches):
        for batch in batches:
            own, texts, start, size = batch.column("own"), batch.column("text"), 0, 0
            for i in range(len(texts)):
                size += len(texts[i].as_py() or "")
                if size >= BATCH or i + 1 == len(texts):
                    part = slice(start, i + 1)
                    yield pa.RecordBatch.from_arrays([own[part], tables(texts[part], node)], ["own", "nodes"])
                    start, size = i + 1, 0

    return pages.select("own", "text").mapInArrow(run, StructType([pages.schema["own"], StructField("nodes", _parse_datatype_string(NODES))]))
