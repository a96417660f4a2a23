"""HTML pages to sections of typed blocks, as columns over flat tables of nodes.

The parser hands out a page's nodes (:mod:`folio.operators.html_nodes`); all the
rest is SQL over arrays, from nodes to blocks and sections:

``described``  what holds of a node by itself: pruned or not, block, heading, section,
               and its number among siblings
``blocks``     a block for each node that is one, of the nodes between its ``pre`` and ``end``,
               with its path, normativity and, for algorithms, the heading that names it
``sections``   a section for each heading or holder, with the blocks between two places

Pages are dealt before the parser, which is the one exchange: what moves is a page,
not its nodes, and a page stays one row from there on, so that a task holds one
page's nodes at a time and nothing is sorted or gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.families import BY_ID
from folio.functions.text import JAVA_WHITE
from folio.operators.html_nodes import BLOCK_TAGS, nodes_of
from folio.operators.htmltree import HEADINGS
from folio.operators.schema import BLOCK, BLOCK_FIELDS, EXTRACTED, SECTION, SOURCE
from folio.operators.selectors import sql_matches
from folio.operators.sqltext import first, fresh, full, let, normal, one_of, quoted, rank, struct, transform, where, with_fields

#: Elements of code, and of notes.
CODE_TAGS = frozenset("pre emu-alg emu-grammar emu-code emu-equation".split())
NOTE_TAGS = frozenset("blockquote emu-note emu-example".split())
#: Classes that settle normativity unless rules say otherwise.
INFORMATIVE = ("note", "informative", "non-normative", "warning", "issue", "ednote", "advisement")
EXAMPLE = ("example", "examples")
NORMATIVE = ("normative",)

PAGE = ("own", "body", "root", "scope", "title")


class Rules:
    """Rules of families as SQL: where families share a rule they share its text."""

    def __init__(self, family: str, by_family: dict[str, dict]):
        self.family, self.by_family = family, by_family

    def each(self, value: Callable[[dict], object], text: Callable[[object], str]) -> str:
        """By family; families that the rules don't name follow ``generic``."""
        groups: dict = {}
        for name, rules in self.by_family.items():
            groups.setdefault(value(rules), []).append(name)
        general = value(self.by_family["generic"])
        cases = " ".join(f"WHEN {one_of(self.family, names)} THEN {text(one)}" for one, names in groups.items() if one != general)
        return f"CASE {cases} ELSE {text(general)} END" if cases else text(general)

    def matches(self, rule: str, node: str, at: Callable[[str], str]) -> str:
        def selectors(rules: dict) -> tuple[str, ...]:
            own = rules.get(rule) or ()
            return (own,) if isinstance(own, str) else tuple(own)

        return self.each(selectors, lambda found: sql_matches(found, node, at, fresh))

    def has(self, rule: str) -> str:
        return self.each(lambda rules: bool(rules.get(rule)), lambda x: str(x).lower())

    def kinds(self) -> str:
        """Map of a class to the normativity that it settles."""

        def pairs(rules: dict) -> tuple:
            made: dict[str, str] = {}
            for kind, default in (("normative", NORMATIVE), ("informative", INFORMATIVE), ("example", EXAMPLE)):
                own = rules.get(kind)
                made |= dict.fromkeys(default if own is None else own, kind)
            return tuple(made.items())

        return self.each(pairs, lambda found: f"map({', '.join(quoted(x) for pair in found for x in pair)})" if found else "CAST(NULL AS map<string,string>)")


class Tree:
    """A page's nodes, by their places."""

    def __init__(self, nodes: str, gone: Callable[[str], str] = lambda k: f"{k}.gone"):
        self.nodes, self.gone = nodes, gone

    def at(self, place: str) -> str:
        return f"get({self.nodes}, {place})"

    def below(self, x: str, test: Callable[[str], str] | None = None) -> str:
        """The nodes below ``x`` that are left, in order."""
        part = f"slice({self.nodes}, {x}.pre + 2, {x}.`end` - {x}.pre - 1)"
        return where(part, lambda k: f"NOT {self.gone(k)}" if test is None else f"coalesce({test(k)}, false) AND NOT {self.gone(k)}")

    def elements(self, x: str, *tags: str) -> str:
        return self.below(x, lambda k: one_of(f"{k}.tag", tags))

    def children(self, x: str, *tags: str) -> str:
        return self.below(x, lambda k: f"{k}.parent = {x}.pre AND {one_of(f'{k}.tag', tags)}")

    def text(self, x: str) -> str:
        """All text below an element as it stands; null for none."""
        return f"array_join({transform(self.below(x, lambda k: f'{k}.tag IS NULL'), lambda k: f'{k}.text')}, '')"

    def clean(self, x: str) -> str:
        return f"CASE WHEN {x} IS NOT NULL THEN {normal(self.text(x))} END"

    def anchor(self, x: str) -> str:
        """The first node below that has an id, or is a named link."""
        return first(self.below(x, lambda k: f"{k}.tag IS NOT NULL AND (map_contains_key({k}.attributes, 'id') OR ({k}.tag = 'a' AND map_contains_key({k}.attributes, 'name')))"))


def attribute(x: str, name: str) -> str:
    return f"try_element_at({x}.attributes, '{name}')"


def name_of(anchor: str) -> str:
    return f"coalesce({anchor}.id, {attribute(anchor, 'name')})"


def source(path: str, fragment: str) -> str:
    name, base = full(fragment), "substring_index(own.url, '#', 1)"
    return f"CAST({struct(url=f"concat({base}, coalesce(concat('#', {name}), ''))", fragment=name, path=path)} AS {SOURCE})"


# Nodes.

#: What is left of what a node of the parse has; ``described`` adds to it.
PARSED = ("pre", "end", "parent", "above", "tag", "text", "id", "attributes", "after", "hider", "in_tbody")


def described(parsed: DataFrame, rules: Rules) -> DataFrame:
    """Pages with their nodes ``n`` and what is found of each of them, and with the page's ``body``, ``root``, ``scope`` and ``title``."""
    # Tests come before what was pruned: it is looked up only for the few nodes that pass.
    gone = lambda x: f"(size(places) > 0 AND (array_contains(places, {x}.pre) OR arrays_overlap(places, {x}.above)))"
    tree = Tree("nodes", gone)
    cut = transform(where("nodes", lambda x: f"{x}.tag IS NOT NULL AND {rules.matches('prune', x, tree.at)}"), lambda x: struct(pre=f"{x}.pre", parent=f"{x}.parent", tag=f"{x}.tag"))
    rows = parsed.selectExpr("own", "nodes", f"{cut} AS cut", f"{rules.kinds()} AS kinds")
    rows = rows.selectExpr("*", "cut.pre AS places")
    left = lambda x, test: f"({x}.tag IS NOT NULL AND coalesce({test}, false) AND NOT {gone(x)})"
    element = lambda test: first(where("nodes", lambda x: left(x, test(x))))
    rows = rows.selectExpr(
        "*", f"coalesce({element(lambda x: f"{x}.tag = 'body'")}.pre, {element(lambda x: f'{x}.parent = -1')}.pre, -1) AS body",
        f"{element(lambda x: rules.matches('root', x, tree.at))}.pre AS own_root", f"{element(lambda x: f"{x}.tag = 'title'")} AS t",
    )
    # Sections by a selector fall back on the headings of the whole body.
    scope = f"CASE WHEN {rules.has('sections')} AND NOT {rules.has('single_pre')} THEN body ELSE coalesce(own_root, body) END"
    # Among siblings of a tag those that are pruned don't count.
    earlier = lambda x: where("cut", lambda c: f"{c}.parent = {x}.parent AND {c}.tag = {x}.tag AND {c}.pre < {x}.pre")

    def found(x: str) -> str:
        own = first(where(transform(f"{x}.classes", lambda k: f"try_element_at(kinds, {k})"), lambda v: f"{v} IS NOT NULL"))
        rule = lambda name: left(x, rules.matches(name, x, tree.at))
        fields = {
            "nth": f"CASE WHEN size(cut) = 0 OR {x}.tag IS NULL THEN {x}.nth ELSE {x}.nth - size({earlier(x)}) END", "gone": gone(x), "algorithm": rule("algorithm"), "grammar": rule("grammar"),
            "section": rule("sections"), "heading": left(x, one_of(f"{x}.tag", HEADINGS)), "norm": f"CASE WHEN {left(x, f'size({x}.classes) > 0')} THEN {own} END",
        }
        return with_fields(x, fields, PARSED)

    return rows.selectExpr("own", "body", "coalesce(own_root, body) AS root", f"{scope} AS scope", f"coalesce({tree.text('t')}, '') AS title", f"{transform('nodes', found)} AS n")


def is_block(x: str) -> str:
    return f"(NOT {x}.gone AND ({one_of(f'{x}.tag', BLOCK_TAGS)} OR {x}.algorithm OR {x}.grammar))"


def in_body(x: str) -> str:
    return f"array_contains({x}.above, body)"


def path_of(tree: Tree, x: str) -> str:
    """An element's steps from the body down; null outside the body."""
    path = transform(f"concat({where(f'{x}.above', lambda a: f'{a} > body')}, array({x}.pre))", lambda a: f"concat({tree.at(a)}.tag, ':nth-of-type(', {tree.at(a)}.nth, ')')")
    return f"CASE WHEN {x}.pre = body THEN '' WHEN {in_body(x)} THEN array_join({path}, ' > ') END"


def nearest(x: str, value: Callable[[str], str], test: Callable[[str], str]) -> str:
    """From the element up the first ``value`` of a place that isn't null; of the ancestors only those that pass ``test``."""
    return first(where(transform(f"reverse(concat({where(f'{x}.above', test)}, array({x}.pre)))", value), lambda v: f"{v} IS NOT NULL"))


# Blocks.


def links(tree: Tree, x: str) -> str:
    href = lambda k: attribute(k, "href")
    one = lambda k: struct(text=f"coalesce({full(tree.clean(k))}, {href(k)})", href=href(k), resolved_id=f"CASE WHEN startswith({href(k)}, '#') THEN substring({href(k)}, 2) END")
    return transform(tree.below(x, lambda k: f"{k}.tag = 'a' AND {href(k)} <> ''"), one)


def productions(text: str) -> str:
    lines = f"split(regexp_replace(replace({text}, '\\r\\n', '\\n'), r'^[{JAVA_WHITE}]+|[{JAVA_WHITE}]+$', ''), '\\n', -1)"
    pattern = rf"r'(?s)^[{JAVA_WHITE}]*([^:]+)::=[{JAVA_WHITE}]*(.+)\z'"
    part = lambda t, i: normal(f"regexp_extract({t}, {pattern}, {i})")
    return transform(where(lines, lambda t: f"{t} RLIKE {pattern}"), lambda t: struct(lhs=part(t, 1), rhs=part(t, 2)))


def definitions(items: str) -> str:
    """A term and the definitions up to the next one, of (is a term, text) in order; those before the first term have none."""
    starts = where(transform(items, lambda k, i: f"CASE WHEN {k}.term OR {i} = 0 THEN {i} END", True), lambda i: f"{i} IS NOT NULL")

    def pair(s: str, at: str, j: str) -> str:
        skip = f"CASE WHEN get({items}, {at}).term THEN 1 ELSE 0 END"
        texts = transform(f"slice({items}, {at} + {skip} + 1, coalesce(get({s}, {j} + 1), size({items})) - {at} - {skip})", lambda k: f"{k}.text")
        term = f"CASE WHEN get({items}, {at}).term THEN get({items}, {at}).text ELSE '' END"
        return struct(term=term, definition=f"array_join({where(texts, lambda t: f"{t} <> ''")}, ' ')")

    return let(starts, lambda s: transform(s, lambda at, j: pair(s, at, j), True))


def cells(tree: Tree, row: str, *tags: str) -> str:
    return transform(tree.elements(row, *tags), tree.clean)


def blocks(pages: DataFrame) -> DataFrame:
    """Pages with ``made``, what each of their blocks is, ``block`` null where it has nothing to say.

    A block is what its rule, for algorithms and grammars, or its element makes it.
    """
    tree = Tree("n")

    def heading_before(k: str) -> str:
        """The last heading among the siblings before; where that is pruned, the last one that isn't."""
        left = transform(where("n", lambda h: f"{h}.heading AND {h}.parent = {k}.parent AND {h}.pre < {k}.pre"), lambda h: f"{h}.pre")
        return f"CASE WHEN {k}.after IS NOT NULL THEN CASE WHEN {tree.at(f'{k}.after')}.gone THEN array_max({left}) ELSE {k}.after END END"

    titled = lambda x: let(tree.at(nearest(x, lambda a: let(tree.at(a), heading_before), lambda a: f"(NOT {in_body(x)} OR {a} > body)")), lambda h: f"CASE WHEN {h} IS NOT NULL THEN {tree.text(h)} END")
    rule = lambda x: f"CASE WHEN {x}.algorithm THEN 'algorithm' WHEN {x}.grammar THEN 'grammar'"
    tags = {"paragraph": ("p",), "note": NOTE_TAGS, "code": CODE_TAGS, "list": ("ul", "ol"), "definitionList": ("dl",), "table": ("table", "emu-table")}
    kind = lambda x: " ".join(f"WHEN {one_of(f'{x}.tag', t)} THEN '{name}'" for name, t in tags.items())

    def block_node(x: str) -> str:
        norm = f"CASE WHEN {in_body(x)} THEN {nearest(x, lambda a: f'{tree.at(a)}.norm', lambda a: f'{a} > body')} END"
        return with_fields(x, {"path": path_of(tree, x), "norm": norm}, ("pre", "end", "tag", "id", "attributes", "hider", "heading"))

    of_block = lambda x: struct(x=block_node(x), heading=f"CASE WHEN {x}.algorithm THEN {titled(x)} END", type=f"{rule(x)} {kind(x)} END")
    rows = pages.selectExpr(*PAGE, "n", f"{transform(where('n', is_block), of_block)} AS made")

    def then(fields: Callable[[str, str, Tree, Callable[..., str]], dict[str, str]], *kept: str) -> None:
        """One step: of each block the fields ``kept`` and more, which ``fields`` makes of the block, its node, the nodes below and a test of its type."""
        nonlocal rows

        def one(b: str) -> str:
            of = lambda value, *types: f"CASE WHEN {one_of(f'{b}.type', types)} THEN {value} END"
            return with_fields(b, fields(b, f"{b}.x", tree, of), kept)

        rows = rows.selectExpr(*PAGE, "n", f"{transform('made', one)} AS made")

    then(lambda b, x, tree, of: {
        "raw": of(tree.text(x), "paragraph", "note", "code", "grammar"), "ol": of(f"CASE WHEN {x}.tag = 'ol' THEN {tree.at(f'{x}.pre')} ELSE {first(tree.elements(x, 'ol'))} END", "algorithm"),
        "dl": of(transform(tree.children(x, "dt", "dd"), lambda k: struct(term=f"{k}.tag = 'dt'", text=tree.clean(k))), "definitionList"), "every_tr": of(tree.elements(x, "tr"), "table"),
        "thead": of(first(tree.elements(x, "thead")), "table"), "anchor": f"CASE WHEN {x}.id IS NULL THEN {tree.anchor(x)} END",
    }, "x", "heading", "type")

    def table_parts(b, x, tree, of):
        empty = "CAST(array() AS array<string>)"
        named = f"CASE WHEN {b}.thead IS NOT NULL THEN {cells(tree, f'{b}.thead', 'th', 'td')} WHEN size({b}.every_tr) > 0 THEN {let(first(f'{b}.every_tr'), lambda r: cells(tree, r, 'th'))} ELSE {empty} END"
        bodies = where(f"{b}.every_tr", lambda r: f"{r}.in_tbody")
        return {"headers": of(where(named, lambda h: f"{h} <> ''"), "table"), "tr": of(let(bodies, lambda v: f"CASE WHEN size({v}) > 0 THEN {v} ELSE {b}.every_tr END"), "table")}

    then(table_parts, "x", "heading", "type", "raw", "ol", "dl", "anchor")

    def filled(b, x, tree, of):
        headed = f"(size({b}.headers) > 0 AND coalesce(size({let(first(f'{b}.tr'), lambda r: tree.elements(r, 'th'))}) > 0, false))"
        kept = f"CASE WHEN {headed} THEN slice({b}.tr, 2, size({b}.tr)) ELSE {b}.tr END"
        lines = where(transform(kept, lambda r: cells(tree, r, "th", "td")), lambda r: f"size({r}) > 0")
        code = rf"regexp_replace(regexp_replace({b}.raw, '\n{{3,}}', '\n\n'), r'[{JAVA_WHITE}]+$', '')"
        title = f"coalesce({full(attribute(x, 'data-algorithm'))}, {full(attribute(x, 'aria-label'))}, {b}.heading)"
        items = where(transform(tree.children(x, "li"), tree.clean), lambda t: f"{t} <> ''")
        # Steps are numbered over all items, blank ones left out.
        steps = where(transform(tree.children(f"{b}.ol", "li"), lambda k, i: struct(step_id=f"CAST({i} + 1 AS string)", text=tree.clean(k)), True), lambda s: f"{s}.text <> ''")
        return {
            "text": f"coalesce({of(normal(f'{b}.raw'), 'paragraph', 'note')}, {of(code, 'code')})", "items": of(items, "list"), "ordered": of(f"{x}.tag = 'ol'", "list"), "definitions": of(definitions(f"{b}.dl"), "definitionList"),
            "rows": of(lines, "table"), "steps": of(steps, "algorithm"), "named": of(f"CASE WHEN {title} IS NOT NULL THEN {normal(title)} END", "algorithm"), "productions": of(productions(f"{b}.raw"), "grammar"),
            "name": f"coalesce({x}.id, {name_of(f'{b}.anchor')})",
        }

    then(filled, "x", "type", "headers")

    def whole(b, x, tree, of):
        says = " OR ".join([f"coalesce({b}.text <> '', false)", *[f"coalesce(size({b}.{c}) > 0, false)" for c in ("items", "definitions", "headers", "rows", "steps", "productions")]])
        parts = {f: f"{b}.{f}" for f in ("type", "text", "ordered", "items", "definitions", "headers", "rows", "steps", "productions")}
        normativity = f"coalesce({x}.norm, CASE WHEN own.authority = 'normative' THEN 'normative' ELSE 'informative' END)"
        parts |= {"id": f"{b}.name", "title": f"{b}.named", "normativity": normativity, "links": links(tree, x), "source": source(f"{x}.path", f"{b}.name")}
        block = f"CAST({struct(**{f: parts.get(f, 'NULL') for f in BLOCK_FIELDS})} AS {BLOCK})"
        return {"pre": f"{x}.pre", "hider": f"{x}.hider", "is_heading": f"{x}.heading", "block": f"CASE WHEN {says} THEN {block} END"}

    then(whole)
    return rows


# Sections.


def sections(pages: DataFrame, rules: Rules) -> DataFrame:
    """Pages with their ``sections``, numbered."""
    pages = pages.selectExpr("*", f"{transform('made', lambda m: f'{m}.pre')} AS places")
    tree, single = Tree("n"), rules.has("single_pre")

    def shown(start: str, end: str, container: str, headings: bool) -> str:
        """The blocks from one place up to another, without those that a block or section below the container hides."""
        part = let(rank("places", start), lambda a: f"slice(made, {a} + 1, greatest({rank('places', end)} - {a}, 0))")
        good = where(part, lambda m: f"{m}.block IS NOT NULL AND {m}.hider <= {container}" + ("" if headings else f" AND NOT {m}.is_heading"))
        return transform(good, lambda m: f"{m}.block")

    heads = where("n", lambda x: f"NOT {x}.gone AND {x}.heading AND {x}.pre > scope AND {x}.pre < {tree.at('scope')}.`end`")
    pages = pages.selectExpr(
        "*", f"{heads} AS heads", f"CASE WHEN {single} THEN {let(tree.at('root'), lambda r: first(tree.elements(r, 'pre')))} END AS pre",
        f"CASE WHEN NOT {single} AND {rules.has('sections')} THEN {let(tree.at('root'), lambda r: tree.below(r, lambda x: f'{x}.section'))} END AS holders", f"{tree.at('body')} AS whole",
    )

    def item(container: str, heading: str, path: str, blocks: str, titled: bool = False) -> str:
        return struct(container=container, heading=heading, path=path, blocks=blocks, titled=str(titled).lower())

    def holder(c: str) -> str:
        return let(first(tree.below(c, lambda k: f"{k}.heading")), lambda h: item(c, h, f"coalesce({path_of(tree, h)}, {path_of(tree, c)})", shown(f"{c}.pre + 1", f"{c}.`end`", f"{c}.pre", True)))

    by_heading = transform("heads", lambda h, i: item(h, h, path_of(tree, h), shown(f"{h}.pre", f"coalesce(get(heads, {i} + 1).pre, {tree.at('scope')}.`end`)", "scope", False)), True)
    in_all = f"array({item('get(n, -1)', 'get(n, -1)', path_of(tree, 'whole'), shown('whole.pre + 1', 'whole.`end`', 'whole.pre', True), True)})"
    in_pre = f"array({item('pre', 'get(n, -1)', path_of(tree, 'pre'), shown('pre.pre', 'pre.pre + 1', str(1 << 30), True), True)})"
    selected = where(transform("holders", holder), lambda s: f"size({s}.blocks) > 0 OR coalesce({tree.clean(f'{s}.heading')}, '') <> ''")
    pages = pages.selectExpr("own", "title", "n", f"CASE WHEN size(heads) > 0 THEN {by_heading} ELSE {in_all} END AS by_heading", f"{selected} AS selected", f"{tree.clean('pre')} AS said", f"{in_pre} AS in_pre")
    chosen = "CASE WHEN coalesce(said <> '', false) THEN in_pre WHEN coalesce(size(selected) > 0, false) THEN selected ELSE by_heading END"

    def with_parts(s: str) -> str:
        h, c = f"{s}.heading", f"{s}.container"
        link = first(tree.below(h, lambda k: f"{k}.tag = 'a' AND startswith({attribute(k, 'href')}, '#')"))
        fields = {"said": tree.clean(h), "in_heading": tree.anchor(h), "in_container": tree.anchor(c), "link": link}
        return with_fields(s, fields, ("container", "heading", "path", "blocks", "titled"))

    pages = pages.selectExpr("own", "title", "n", f"{chosen} AS chosen")
    pages = pages.selectExpr("own", "title", f"{transform('chosen', with_parts)} AS chosen")

    def with_name(s: str) -> str:
        found = f"CASE WHEN {s}.in_heading IS NOT NULL THEN {name_of(f'{s}.in_heading')} WHEN {s}.in_container IS NOT NULL THEN {name_of(f'{s}.in_container')} ELSE substring({attribute(f'{s}.link', 'href')}, 2) END"
        # A section for a whole page has its title for a heading, and an id only of its own.
        name = f"CASE WHEN {s}.titled THEN {s}.container.id ELSE coalesce({s}.container.id, {s}.heading.id, {found}) END"
        return with_fields(s, {"name": name}, ("heading", "path", "blocks", "titled", "said"))

    def section(s: str, at: str) -> str:
        heading = f"CASE WHEN {s}.titled THEN coalesce({full('title')}, 'Document') ELSE coalesce({full(f'{s}.said')}, 'Untitled') END"
        level = f"CASE WHEN {s}.heading IS NOT NULL THEN CAST(substring({s}.heading.tag, 2, 1) AS int) ELSE 1 END"
        numbered = transform(f"{s}.blocks", lambda b, j: struct(**{f: f"{b}.{f}" if f != "ordinal" else j for f in BLOCK_FIELDS}), True)
        return f"CAST({struct(ordinal=at, id=f'{s}.name', heading=heading, level=level, source=source(f'{s}.path', f'{s}.name'), blocks=numbered)} AS {SECTION})"

    return pages.selectExpr("own", "title", f"{transform(transform('chosen', with_name), section, True)} AS sections")


def extract_pages(pages: DataFrame, text: str = "text", rules: dict[str, dict] | None = None, families: Iterable[str] = tuple(BY_ID)) -> DataFrame:
    """``pages`` (with ``url``, ``family``, ``authority``) with ``e``, the extraction of their text by the rules of their family, in place of ``text``.

    ``rules`` come before those of the known ``families``; naming fewer of these
    makes the plan smaller.
    """
    by_family = {f: BY_ID[f].html_rules() for f in dict.fromkeys(("generic", *families))} | (rules or {})
    own = F.struct(*[F.coalesce(c, F.lit("")).alias(c) if c == "url" else F.col(c) for c in pages.columns if c != text])
    rule = Rules("own.family", by_family)
    dealt = pages.select(F.monotonically_increasing_id().alias("page"), own.alias("own"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartition("page")
    made = sections(blocks(described(nodes_of(dealt), rule)), rule)
    title = f"coalesce({full('title')}, get(sections, 0).heading, 'Untitled')"
    e = f"CAST({struct(title=title, sections='sections', warnings='NULL')} AS {EXTRACTED})"
    # A generator of one row, an outer one: a filter on what comes out of it isn't moved before it, where the extraction would run twice.
    return made.selectExpr("own", f"explode_outer(array({e})) AS e").selectExpr("own.*", "e")


def extract_html(text: str | None, url: str, rules: dict, authority: str = "informative") -> dict:
    """One page, for looking at: ``title``, ``sections`` and ``warnings``."""
    spark = SparkSession.builder.getOrCreate()
    row = spark.createDataFrame([(text or "", url, "own", authority)], "text string, url string, family string, authority string")
    return extract_pages(row, rules={"own": rules}, families=()).first()["e"].asDict(True)
