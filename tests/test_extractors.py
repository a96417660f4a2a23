"""HTML, XML and PDF extraction on small inputs."""

import zlib

import pytest

from folio.functions.families import BY_ID
from folio.operators.html_extract import extract_html
from folio.operators.htmltree import Document
from folio.operators.pdf_extract import page_texts
from folio.operators.selectors import matches, query_all
from folio.operators.xml_extract import extract_xml

U = "https://h.example/page"


def blocks(html, rules=None, **kw):
    return [b for s in extract_html(f"<body>{html}</body>", U, rules or {}, **kw)["sections"] for b in s["blocks"]]


def texts(html, rules=None):
    return [b["text"] for b in blocks(html, rules)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h1>T</h1><p>a<p>b</p>c", ["a", "b"]),
        ("<p>before</p><h1>T</h1><p>after", ["after"]),
        ("<h1>T</h1><section><p>in</p></section><p>out</p>", ["out"]),
        ("<p>no heading</p>", ["no heading"]),
        ("<h1>T</h1><p><b>x<br><p>y</b> z", ["x", "y z"]),
        ("<h1>T</h1><p>a &amp; b&nbsp;c &#233;</p>", ["a & b c é"]),
        ("<h1>T</h1><script>var a='<p>no</p>'</script><!-- <p>no</p> --><p>yes</p>", ["yes"]),
        ("<h1>T</h1><blockquote><p>q</p></blockquote>", ["q"]),
        ("<h1>T</h1><pre>\n\na\n\n\n\nb  \n</pre>", ["\na\n\nb"]),
        ("<h1>T</h1><p> </p><p>1 < 2</p>", ["1 < 2"]),
    ],
)
def test_blocks(html, want):
    assert texts(html) == want


def test_lists_tables_definitions():
    made = blocks("<h2 id=s>T</h2><ol><li>a<li>b<ul><li>c</ul></ol><dl><dd>x<dt>t<dd>y<dd>z</dl><table><tr><th>A<th>B<tr><td>1<td>2</table><table><tr><td>only</table>")
    assert [b["type"] for b in made] == ["list", "definitionList", "table", "table"]
    assert made[0]["items"] == ["a", "bc"] and made[0]["ordered"]
    assert made[1]["definitions"] == [{"term": "", "definition": "x"}, {"term": "t", "definition": "y z"}]
    assert (made[2]["headers"], made[2]["rows"]) == (["A", "B"], [["1", "2"]])
    assert (made[3]["headers"], made[3]["rows"]) == ([], [["only"]])
    assert made[3]["source"] == {"url": U, "fragment": None, "path": "table:nth-of-type(2)"}


def test_rows_outside_tables_are_dropped():
    assert blocks("<h1>T</h1><emu-table><tr><td>x</td></tr></emu-table>") == []


def test_sections_by_selector_and_ids():
    got = extract_html("<body><section id=a><h2>A</h2><p>x</p></section><section><h3><a name=b></a>B</h3></section><section></section></body>", U, {"sections": "section"})
    assert [(s["id"], s["heading"], s["level"], len(s["blocks"])) for s in got["sections"]] == [("a", "A", 2, 1), ("b", "B", 3, 0)]
    assert got["sections"][1]["source"]["url"] == f"{U}#b"
    link = extract_html("<h1>T <a href='#x'>l</a></h1><p>t</p>", U, {})["sections"][0]
    assert (link["id"], link["heading"]) == ("x", "T l")


def test_single_pre():
    rules = BY_ID["rfc"].html_rules()
    got = extract_html("<title>R</title><h1>no</h1><pre id=p>text\n</pre><pre>more</pre>", U, rules, "normative")
    assert [(s["id"], s["heading"], [b["text"] for b in s["blocks"]]) for s in got["sections"]] == [("p", "R", ["text"])]
    assert extract_html("<h1>T</h1><pre>  </pre><p>x", U, rules)["sections"][0]["heading"] == "T"


def test_algorithms_and_grammars():
    rules = BY_ID["w3c"].html_rules() | {"sections": None}
    made = blocks("<h2>Do</h2><div class=algorithm><ol><li>a<li><li>c</ol></div><pre class=idl>interface X</pre><pre class=bnf>a ::= b c\nno\n d::=e</pre>", rules)
    assert [b["type"] for b in made] == ["algorithm", "algorithm", "grammar"]
    assert made[0]["title"] == "Do" and [(s["step_id"], s["text"]) for s in made[0]["steps"]] == [("1", "a"), ("3", "c")]
    assert made[2]["productions"] == [{"lhs": "a", "rhs": "b c"}, {"lhs": "d", "rhs": "e"}]


def test_normativity_and_links():
    made = blocks("<h1>T</h1><div class='x note'><p class=normative>a</p><p>b <a href='#i'>i</a><a href='/r'></a><a href=''>e</a></p></div>", authority="normative")
    assert [b["normativity"] for b in made] == ["normative", "informative"]
    assert made[1]["links"] == [{"text": "i", "href": "#i", "resolved_id": "i"}, {"text": "/r", "href": "/r", "resolved_id": None}]


def test_prune_and_root():
    rules = {"prune": ["nav", ".toc"], "root": "main"}
    assert texts("<main><h1>T</h1><nav><p>n</p></nav><div class='a toc'><p>t</p></div><p>m</p></main><p>o</p>", rules) == ["m"]
    got = extract_html("<p>x</p>", U, {"prune": ["body"]})["sections"]
    assert [(s["heading"], s["blocks"]) for s in got] == [("Document", [])]


def test_selectors():
    root = Document("<main><div class='a b' id=i><p data-x='y1'>t</p></div><p>u</p></main>").root
    count = lambda s: len(query_all(root, s))
    assert [count(s) for s in ("p", "div > p", "main > p", "main p", ".a.b", "#i", "[data-x]", "[data-x='y1']", "[data-x^=y]", "p, div", "div p, main", "p::x", "> p", "")] == [2, 1, 1, 2, 1, 1, 1, 1, 1, 3, 2, 0, 0, 0]
    assert not matches(query_all(root, "p")[0], "(")


def test_tree_rules():
    body = Document("<table><tr><td>a<td>b<tr><td>c</table>").body
    assert [n.tag for n in body.walk()] == ["table", "tbody", "tr", "td", "td", "tr", "td"]
    assert Document("<title>a &amp; <b></title>x").title == "a & <b>"
    assert Document("").body is not None and Document("<html><body></body></html> text").body.text().strip() == "text"
    assert Document("<table>x<tr><td>y</table>").body.text() == "xy"


def test_xml_of_any_depth():
    deep = extract_xml("<a>" * 5000 + "x" + "</a>" * 5000, U)
    assert deep["sections"][0]["blocks"][0]["items"] == ["/a" * 5000 + "/#text: x"]
    model = "<xs:sequence>" * 3000 + '<xs:element name="m"/>' + "</xs:sequence>" * 3000
    schema = f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:group name="g">{model}</xs:group></xs:schema>'
    assert extract_xml(schema, U)["sections"][2]["blocks"][0]["definitions"] == [{"term": "group g", "definition": "elements=[m]"}]


def test_xml_lines_and_errors():
    got = extract_xml("<a x='1'>t<b/><c>u</c><b>v</b></a>", U)
    assert got["sections"][0]["blocks"][0]["items"] == ["/a @x: 1", "/a/b[1]/#text: v", "/a/c/#text: u", "/a/#text: t"]
    assert extract_xml("<a><b></a>", U)["warnings"][0].startswith("XML parse failed: ")
    assert extract_xml("<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>", U)["warnings"]
    assert extract_xml("", U)["sections"][0]["heading"] == "document"
    many = extract_xml(f"<r>{'<i>x</i>' * 2500}</r>", U)["sections"][0]["blocks"][0]["items"]
    assert len(many) == 2000


def test_schema():
    xsd = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" version="1"><xs:element name="e"><xs:complexType><xs:sequence>
    <xs:element ref="f" minOccurs="0"/></xs:sequence><xs:attribute name="a" use="required"/></xs:complexType></xs:element>
    <xs:complexType name="c"><xs:annotation><xs:documentation>Some <b>text</b></xs:documentation></xs:annotation><xs:complexContent><xs:extension base="d"/></xs:complexContent>
    <xs:assert test="@a"/></xs:complexType><xs:simpleType name="s"><xs:restriction base="xs:int"><xs:maxInclusive value="5" fixed="true"/></xs:restriction></xs:simpleType></xs:schema>"""
    got = {s["id"]: [(d["term"], d["definition"]) for d in s["blocks"][0]["definitions"]] for s in extract_xml(xsd, U)["sections"]}
    assert got["elements"] == [("element e", "elements=[f (minOccurs=0)]; attributes=[a (use=required)]"), ("element ref:f", "minOccurs=0")]
    assert got["complex-types"] == [("complexType (anonymous)", "elements=[f (minOccurs=0)]; attributes=[a (use=required)]"), ("complexType c", "base=d; assertions=[assert(test=@a)]; doc=Some text")]
    assert got["simple-types"] == [("simpleType s", "base=xs:int; facets=[maxInclusive(value=5, fixed=true)]")]
    assert got["schema-metadata"] == [("version", "1"), ("xmlns:xs", "http://www.w3.org/2001/XMLSchema")]


def pdf(content, packed=False):
    body = zlib.compress(content) if packed else content
    head = b"/Filter /FlateDecode " if packed else b""
    return b"%PDF-1.4\n1 0 obj <</Type /Page /Contents 2 0 R>> endobj\n2 0 obj <<" + head + b"/Length %d>>\nstream\n%s\nendstream endobj\n" % (len(body), body)


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(packed):
    assert page_texts(pdf(b"BT (Hello \\(x\\)) Tj [(W) -20 (orld)] TJ <2142> Tj ET", packed)) == ["Hello (x) World !B"]


@pytest.mark.parametrize("bad", [b"", b"text", b"%PDF-1.4 nothing"])
def test_bad_pdf(bad):
    with pytest.raises(ValueError):
        page_texts(bad)
