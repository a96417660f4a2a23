"""XML and XML Schema texts to sections, as columns over flat tables of elements.

Schemas become lists of definitions by kind, any other text becomes its lines of
path and value.  The parser hands out a text's elements
(:mod:`folio.operators.xml_nodes`); what an element holds is an interval of them.
Texts are dealt once, before the parser, and stay one row each from there on; a
schema's definitions are an array, each with the elements below it on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.schema import BLOCK, BLOCK_FIELDS, EXTRACTED, SECTION
from folio.operators.sqltext import first, full, let, normal, one_of, quoted, struct, transform, where, with_fields
from folio.operators.xml_nodes import elements_of

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
FIELDS = ("pre", "end", "parent", "name", "nth", "of", "attributes", "text")


class Tree:
    """A stretch of a text's elements, from the place behind ``base`` on."""

    def __init__(self, nodes: str, base: str = "-1"):
        self.nodes, self.base = nodes, base

    def below(self, x: str) -> str:
        return f"slice({self.nodes}, {x}.pre - {self.base} + 1, {x}.`end` - {x}.pre - 1)"

    def deep(self, x: str, *locals_: str) -> str:
        """Descendants of these names, parents before children."""
        return where(self.below(x), lambda k: one_of(f"{k}.local", locals_))

    def all(self, x: str, *locals_: str) -> str:
        return where(self.below(x), lambda k: f"{k}.parent = {x}.pre AND {one_of(f'{k}.local', locals_)}")

    def first(self, x: str, local: str) -> str:
        return first(self.all(x, local))


def attribute(x: str, name: str) -> str:
    """The value of an attribute, null without it."""
    return f"{first(where(f'{x}.attributes', lambda a: f'{a}.name = {quoted(name)}'))}.value"


def own(x: str, name: str) -> str:
    """The value of an attribute, null where it is empty."""
    return full(attribute(x, name))


def either(*values: str) -> str:
    return f"coalesce({', '.join(values)})"


def summary(items: str, limit: int) -> str:
    """The first names and how many more there are."""
    return let(items, lambda v: f"concat(array_join(slice({v}, 1, {limit}), ', '), CASE WHEN size({v}) > {limit} THEN concat(', ... (+', size({v}) - {limit}, ' more)') ELSE '' END)")


def listed(name: str, items: str, limit: int = NAMES) -> str:
    return let(items, lambda v: f"CASE WHEN size({v}) > 0 THEN concat('{name}=[', {summary(v, limit)}, ']') END")


def options_of(x: str) -> str:
    return f"array_join({transform(f'{x}.attributes', lambda a: f"concat({a}.name, '=', {a}.value)")}, ', ')"


def brief(x: str, names: tuple[str, ...]) -> str:
    """An element or attribute inside a model, with some of its options."""
    options = f"array_join(array({', '.join(f"concat('{n}=', {own(x, n)})" for n in names)}), ', ')"
    label = either(own(x, "name"), own(x, "ref"), "'(anonymous)'")
    return let(options, lambda o: normal(f"CASE WHEN {o} <> '' THEN concat({label}, ' (', {o}, ')') ELSE {label} END"))


def within(tree: Tree, x: str, local: str, names: tuple[str, ...]) -> str:
    """What a content model holds of one name; what stands inside such an element is its own affair."""
    outer = lambda v: where(v, lambda k: f"NOT exists({v}, m -> m.pre < {k}.pre AND {k}.pre < m.`end`)")
    return transform(let(tree.deep(x, local), outer), lambda k: brief(k, names))


def facets(tree: Tree, restriction: str) -> str:
    kept = where(tree.below(restriction), lambda k: f"{k}.parent = {restriction}.pre AND NOT {one_of(f'{k}.local', ('annotation', 'simpleType'))}")

    def one(k: str) -> str:
        plain = f"size({k}.attributes) = 1 AND {k}.attributes[0].name = 'value'"
        return normal(f"CASE WHEN {plain} THEN concat({k}.local, '=', {k}.attributes[0].value) WHEN size({k}.attributes) > 0 THEN concat({k}.local, '(', {options_of(k)}, ')') ELSE {k}.local END")

    return transform(kept, one)


def assertions(tree: Tree, x: str) -> str:
    return transform(tree.deep(x, "assert"), lambda k: f"CASE WHEN size({k}.attributes) > 0 THEN {normal(f"concat('assert(', {options_of(k)}, ')')")} ELSE 'assert' END")


def base_of(tree: Tree, x: str) -> str:
    """What a complex type extends or restricts."""
    ways = [let(tree.first(x, content), lambda c, way=way: let(tree.first(c, way), lambda w: own(w, "base"))) for content in ("complexContent", "simpleContent") for way in ("extension", "restriction")]
    return either(*ways)


#: How a simple type is made: the element, its attribute, the name of that in a definition, and in front of an inline type.
WAYS = (("restriction", "base", "base", ""), ("list", "itemType", "listOf", "list:"), ("union", "memberTypes", "unionOf", "union:"))


def inline_type(tree: Tree, x: str) -> str:
    """What an inline simple type is made from; null without one."""

    def made(inner: str) -> str:
        return f"CASE WHEN {inner} IS NOT NULL THEN {either(*[f"concat('{prefix}', {let(tree.first(inner, local), lambda w, name=name: own(w, name))})" for local, name, _, prefix in WAYS], "'inline'")} END"

    return let(tree.first(x, "simpleType"), made)


def simple_type(tree: Tree, x: str) -> list[str]:
    """The base of a simple type, and the facets of a restriction; the first way of making one counts."""
    out = []
    for i, (local, name, key, _) in enumerate(WAYS):
        earlier = " AND ".join([f"{tree.first(x, other)} IS NULL" for other, *_ in WAYS[:i]] or ["true"])
        out.append(f"CASE WHEN {earlier} THEN {let(tree.first(x, local), lambda w, name=name, key=key: f"concat('{key}=', {either(own(w, name), inline_type(tree, w))})")} END")
        if local == "restriction":
            out.append(let(tree.first(x, local), lambda w: f"CASE WHEN {w} IS NOT NULL THEN {listed('facets', facets(tree, w))} END"))
    return out


def documentation(tree: Tree, x: str) -> str:
    def text(d: str) -> str:
        every = f"concat(array({d}.text), {transform(tree.below(d), lambda k: f'{k}.text')})"
        return normal(f"array_join({where(every, lambda t: f"{t} <> ''")}, ' ')")

    texts = f"flatten({transform(tree.all(x, 'annotation'), lambda a: transform(tree.all(a, 'documentation'), text))})"
    return normal(f"array_join({where(texts, lambda t: f"{t} <> ''")}, ' ')")


def definition(tree: Tree, x: str) -> str:
    """One definition as ``key=value`` pairs, by its kind."""
    some = lambda names: [f"concat('{n}=', {attribute(x, n)})" for n in names]
    elements = listed("elements", within(tree, x, "element", ("type", "minOccurs", "maxOccurs")))
    attributes = listed("attributes", within(tree, x, "attribute", ("type", "use")))
    # Only names without a prefix count as inline types.
    child = lambda name: f"exists({tree.below(x)}, k -> k.parent = {x}.pre AND k.name = '{name}')"
    inline = f"CASE WHEN {child('complexType')} THEN 'inlineType=complexType' WHEN {child('simpleType')} THEN 'inlineType=simpleType' END"
    pairs = {
        "element": [*some(ELEMENT_ATTRIBUTES), inline, elements, attributes],
        "attribute": some(ATTRIBUTE_ATTRIBUTES),
        "attributeGroup": [attributes],
        "group": [elements],
        "complexType": [*some(("mixed", "abstract", "block", "final")), f"concat('base=', {base_of(tree, x)})", elements, attributes, listed("assertions", assertions(tree, x), ASSERTIONS)],
        "simpleType": [*some(("final",)), *simple_type(tree, x)],
    }
    cases = " ".join(f"WHEN '{kind}' THEN array({', '.join(p)})" for kind, p in pairs.items())
    short = lambda d: f"CASE WHEN length({d}) > {DOCUMENTATION} THEN concat(left({d}, {DOCUMENTATION - 3}), '...') ELSE {d} END"
    doc = let(full(documentation(tree, x)), lambda d: f"concat('doc=', {short(d)})")
    # array_join leaves out what is null.
    return normal(f"array_join(concat(CASE {x}.local {cases} END, array({doc})), '; ')")


def label_of(x: str) -> str:
    ref = f"CASE WHEN {one_of(f'{x}.local', ('element', 'attribute'))} THEN concat('ref:', {own(x, 'ref')}) WHEN {one_of(f'{x}.local', ('group', 'attributeGroup'))} THEN {own(x, 'ref')} END"
    return normal(f"concat({x}.local, ' ', {either(own(x, 'name'), ref, "'(anonymous)'")})")


def _block(**parts: str) -> str:
    return f"CAST({struct(**{f: parts.get(f, 'NULL') for f in BLOCK_FIELDS})} AS {BLOCK})"


def _section(ordinal: str, name: str, heading: str, block: str) -> str:
    return f"CAST({struct(ordinal=ordinal, id=name, heading=heading, level='1', source='NULL', blocks=f'array({block})')} AS {SECTION})"


def lines_of(n: str) -> str:
    """Lines of an element's attributes, then of its children, then its own text, the first ones; each with the path of its element."""
    last = lambda x: f"{x}.`end` - 1"
    line = lambda a, b, c, d, at, text: struct(a=a, b=b, c=c, d=d, at=at, text=text)
    marks = lambda x: transform(f"{x}.attributes", lambda p, i: line(f"{x}.pre", "0", "0", i, f"{x}.pre", f"concat(' @', {p}.name, ': ', {p}.value)"), True)
    # What an element says itself comes behind all below it, and of elements that end together the inner one first.
    said = lambda x: let(normal(f"{x}.text"), lambda t: f"CASE WHEN {t} <> '' THEN array({line(last(x), '1', f'-{x}.pre', '0', f'{x}.pre', f"concat('/#text: ', {t})")}) ELSE array() END")
    every = f"flatten({transform(n, lambda x: f'concat({marks(x)}, {said(x)})')})"
    step = lambda k: f"concat('/', {k}.name, CASE WHEN {k}.of > 1 THEN concat('[', {k}.nth, ']') ELSE '' END)"
    # Ancestors are those before it that end behind it.
    path = lambda at: f"array_join({transform(where(f'slice({n}, 1, {at} + 1)', lambda k: f'{k}.`end` > {at}'), step)}, '')"
    return transform(f"slice(array_sort({every}), 1, {LINES})", lambda v: f"concat({path(f'{v}.at')}, {v}.text)")


def extract_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` (with ``url``) with ``e``, the extraction of their XML, in place of ``text``.

    What can't be parsed has a warning and no sections.  Elements may nest to any
    depth.
    """
    others = F.struct(*[c for c in texts.columns if c != text])
    dealt = texts.select(F.monotonically_increasing_id().alias("doc"), others.alias("own"), F.coalesce(F.col(text), F.lit("")).alias("t")).repartition("doc")
    parsed = dealt.select("own", elements_of(F.col("t")).alias("p"))
    local = lambda x: f"regexp_extract({x}.name, '([^:]*)$', 1)"
    rows = parsed.selectExpr("own", "p.error AS error", f"{transform('p.elements', lambda x: with_fields(x, {'local': local(x)}, FIELDS))} AS n")
    root = "get(n, 0)"
    rows = rows.selectExpr("*", f"coalesce({root}.local = 'schema', false) AS is_schema")
    kinds = [k for k, *_ in KINDS]
    tree = Tree("n")
    # In the order of a dictionary: signs, then letters whatever their accents and case, which come last.
    about = f"array_sort({where(f'{root}.attributes', lambda a: f"{one_of(f'{a}.name', SCHEMA_ATTRIBUTES)} OR startswith({a}.name, 'xmlns')")}, (a, b) -> CASE WHEN collate(a.name, 'UNICODE') < collate(b.name, 'UNICODE') THEN -1 WHEN a.name = b.name THEN 0 ELSE 1 END)"
    about = transform(about, lambda a: struct(term=normal(f"{a}.name"), definition=normal(f"{a}.value")))
    items = transform(let(root, lambda r: tree.deep(r, *kinds)), lambda x: struct(x=x, part=tree.below(x)))
    rows = rows.selectExpr("own", "error", "is_schema", "n", f"CASE WHEN is_schema THEN {about} END AS about", f"CASE WHEN is_schema THEN {items} ELSE array() END AS items")

    def made(i: str) -> str:
        x = f"{i}.x"
        return struct(local=f"{x}.local", d=struct(term=label_of(x), definition=definition(Tree(f"{i}.part", f"{x}.pre"), x)))

    docs = rows.selectExpr("own", "error", "is_schema", "about", "n", f"{transform('items', made)} AS d")

    of_kind = lambda kind: transform(where("d", lambda v: f"{v}.local = '{kind}'"), lambda v: f"{v}.d")
    found = [struct(id="'schema-metadata'", heading="'Schema Metadata'", block="'schema-attributes'", d="about")] + [struct(id=f"'{name}'", heading=f"'{heading}'", block=f"'{block}'", d=of_kind(kind)) for kind, name, heading, block in KINDS]
    schema = transform(where(f"array({', '.join(found)})", lambda s: f"size({s}.d) > 0"), lambda s, i: _section(i, f"{s}.id", f"{s}.heading", _block(ordinal="0", id=f"{s}.block", type="'definitionList'", definitions=f"{s}.d")), True)
    docs = docs.selectExpr("own", "error", "n", f"CASE WHEN is_schema THEN {schema} END AS schema")
    lines = f"array({_section('0', 'NULL', f"coalesce({root}.name, 'document')", _block(ordinal='0', id="'xml-lines'", type="'list'", items=lines_of('n')))})"
    sections = f"CASE WHEN error IS NOT NULL THEN array() WHEN size(schema) > 0 THEN schema ELSE {lines} END"
    warnings = "CASE WHEN error IS NOT NULL THEN array(error) ELSE array() END"
    e = f"CAST({struct(title='own.url', sections=sections, warnings=warnings)} AS {EXTRACTED})"
    # A generator of one row, an outer one, as for pages: filters stay behind the extraction.
    return docs.selectExpr("own", f"explode_outer(array({e})) AS e").selectExpr("own.*", "e")


def extract_xml(text: str | None, url: str) -> dict:
    """One text, for looking at: ``title``, ``sections`` and ``warnings``."""
    spark = SparkSession.builder.getOrCreate()
    return extract_texts(spark.createDataFrame([(text or "", url)], "text string, url string")).first()["e"].asDict(True)
