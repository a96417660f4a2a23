"""Node tables against plain extractors, mixed JSON folders, families as a table, table functions."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from folio.functions.families import BY_ID, FAMILIES, TABLE, with_family, with_family_table
from folio.functions.table_functions import register
from folio.functions.text import decoded, normalize_url
from folio.operators.html_extract import extract_pages
from folio.operators.xml_extract import extract_texts, extract_xml
from folio.sources.documents import contract_json, read_documents
from tests import plain_html, plain_xml
from tests.test_plans import docs_of, html

TAGS = "p div section ul ol dl table pre blockquote h1 h2 h3 nav article main emu-clause emu-alg emu-note span a li p div aside header footer".split()
SCHEMA = "element attribute attributeGroup group complexType simpleType restriction extension list union sequence choice annotation documentation complexContent simpleContent assert enumeration pattern".split()
ATTRIBUTES = "name ref type base use minOccurs maxOccurs default fixed value itemType memberTypes mixed test final substitutionGroup id".split()


def page(r):
    def text():
        return " ".join(r.choice(["alpha", "<b>bold</b>", "&amp;", "1", "::=", "x:y", "\n", "  ", "k ::= v\n", "\n\n\n\n"]) for _ in range(r.randint(0, 5)))

    def marks():
        out = f' id="{r.choice("abcdefg")}{r.randrange(9)}"' if r.random() < 0.2 else ""
        out += f' class="{r.choice(["note", "example", "normative", "toc", "algorithm", "grammar", "bnf", "warning note", "x y"])}"' if r.random() < 0.25 else ""
        return out + (' data-algorithm=" do it "' if r.random() < 0.05 else "")

    def element(depth=0):
        if depth > 5 or r.random() < 0.15:
            return text()
        tag = r.choice(TAGS)
        if tag in ("ul", "ol"):
            inner = "".join(f"<li{marks()}>{element(depth + 2)}</li>" for _ in range(r.randint(0, 3)))
        elif tag == "dl":
            inner = "".join(f"<{r.choice(['dt', 'dd'])}>{text()}" for _ in range(r.randint(0, 4)))
        elif tag == "table":
            row = lambda: "<tr>" + "".join(f"<{r.choice(['td', 'td', 'th'])}>{text()}" for _ in range(r.randint(0, 3)))
            inner = ("<thead><tr><th>H1<th>H2</thead>" if r.random() < 0.3 else "") + "".join(row() for _ in range(r.randint(0, 3)))
        elif tag == "a":
            return f'<a {r.choice(["href=#x1", "href=/u", "name=n1", "href"])}{marks()}>{text()}</a>'
        elif tag in ("h1", "h2", "h3"):
            inner = text() + r.choice(["", "<a name=q></a>", '<a href="#lk">l</a>'])
        else:
            inner = "".join(element(depth + 1) for _ in range(r.randint(0, 4)))
        return f"<{tag}{marks()}>{inner}</{tag}>"

    title = f"<title>{r.choice(['', 'T &amp; x'])}</title>" if r.random() < 0.5 else ""
    return title + r.choice(["<body>", "<main>", "<article>", ""]) + "".join(element() for _ in range(r.randint(0, 7)))


@pytest.mark.parametrize("seed", range(2))
def test_pages_equal_the_plain_extractor(spark, seed):
    r = random.Random(seed)
    rows = [(i, page(r), r.choice(["https://u.example/p", "https://u.example/p#f", ""]), r.choice([*BY_ID, "w3c", "whatwg", "rfc", "nobody"]), r.choice(["normative", "informative"])) for i in range(150)]
    rows += [(150, "", "u", "generic", "x"), (151, None, None, None, None), (152, "<b>" * 300 + "deep", "u", "generic", "informative")]
    docs = spark.createDataFrame([(*row, "x", 1) for row in rows], "i int, text string, url string, family string, authority string, n string, page int").repartition(3)
    out = extract_pages(docs)
    assert out.columns == ["i", "url", "family", "authority", "n", "page", "e"]
    got = {x["i"]: x["e"].asDict(True) for x in out.collect()}
    assert len(got) == len(rows)
    for i, text, url, family, authority in rows:
        rules = (BY_ID.get(family) or BY_ID["generic"]).html_rules()
        assert got[i] == plain_html.extract_html(text, url, rules, authority), text
    assert extract_pages(docs.limit(0)).count() == 0


def test_one_exchange_for_a_page(spark):
    docs = spark.createDataFrame([("<p>x", "u", "generic", "x")], "text string, url string, family string, authority string")
    plan = extract_pages(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_texts_equal_the_plain_extractor(spark):
    r = random.Random(1)

    def element(depth, names, prefix):
        name, p = r.choice(names), r.choice([prefix, prefix, prefix, ""])
        marks = "".join(f' {k}="{r.choice(["x", "y z", "", "3", " 1 "])}"' for k in r.sample(ATTRIBUTES, r.randint(0, 3)))
        inner = "".join(element(depth + 1, names, prefix) if r.random() < 0.8 else r.choice(["t ", " \n ", "q&amp;a", "é"]) for _ in range(r.randint(0, 4))) if depth < 6 else ""
        return f"<{p}{name}{marks}>{inner}</{p}{name}>"

    rows = [(i, f'<xs:schema xmlns:xs="u" xmlns:q="v" version="1" id=" a " other="o">{"".join(element(0, SCHEMA, "xs:") for _ in range(r.randint(0, 6)))}</xs:schema>') for i in range(100)]
    rows += [(i, f"<r xmlns:c='x'>{''.join(element(0, ['a', 'b', 'c:d'], '') for _ in range(5))}</r>") for i in range(100, 200)]
    rows += [(200, ""), (201, "<a><b></a>"), (202, "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>"), (203, None), (204, "﻿<a>x</a>"), (205, "<x:schema xmlns:x='q'/>")]
    docs = spark.createDataFrame([(*row, "u", 1) for row in rows], "i int, text string, url string, n int").repartition(3)
    got = {x["i"]: x["e"].asDict(True) for x in extract_texts(docs).collect()}
    assert got == {i: plain_xml.extract_xml(t, "u") for i, t in rows}
    assert extract_texts(docs.limit(0)).count() == 0


def test_schema_attributes_in_the_order_of_a_dictionary(spark):
    names = ["xmlns:b", "xmlns:B", "xmlns:_x", "xmlns:é", "xmlns:e", "xmlns:f", "xmlns:a", "xmlns:A", "version", "id"]
    made = extract_xml("<x:schema " + " ".join(f'{n}="v"' for n in names) + "/>", "u")
    assert [d["term"] for d in made["sections"][0]["blocks"][0]["definitions"]] == ["id", "version", "xmlns:_x", "xmlns:a", "xmlns:A", "xmlns:b", "xmlns:B", "xmlns:e", "xmlns:é", "xmlns:f"]


def test_a_folder_of_mixed_json(spark, tmp_path):
    docs = docs_of(spark, html(), ("https://h.example/b", "text", "text/plain", "t"))
    texts = [r["json"] for r in contract_json(docs).collect()]
    others = ["[1, 2]", "7", '"text"', "null", '{"a": 1}', '{"sections": 3}', '{"sections": {"a": 1}}', '{"sections": [1]}', json.dumps([json.loads(texts[0])])]
    for i, text in enumerate(texts + others):
        folder = tmp_path / "in" / "deep" / str(i)
        folder.mkdir(parents=True)
        (folder / "x.json").write_text(text)
    (tmp_path / "in" / "note.txt").write_text("{no json")
    back = read_documents(spark, str(tmp_path / "in"), "json")
    assert sorted(map(str, back.select("url", "sections").collect())) == sorted(map(str, docs.select("url", "sections").collect()))
    (tmp_path / "in" / "bad.json").write_text('{"sections": [')
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING"):
        read_documents(spark, str(tmp_path / "in"), "json").collect()


def test_families_as_a_table(spark):
    rows = [(f.id, i, list(f.hosts), list(f.suffixes), f.authority, f.document_type, f.extractor) for i, f in enumerate(FAMILIES)]
    families = spark.createDataFrame(rows, TABLE)
    urls = ["https://www.w3.org/TR/", "https://html.spec.whatwg.org/x", "https://xunicode.org/", "https://core.ac.uk/", "https://a.core.ac.uk/", "https://core.ac.uk.evil.example/", "https://tc39.es/", "mailto:x", "https://WWW.ARXIV.org/a"]
    entries = spark.createDataFrame([(u, f, a, e, 1) for u in urls for f, a, e in ((None, None, None), ("rfc", None, "pdf"), ("nobody", "draft", ""))], "url string, family string, authority string, extractor string, host int").drop("host")
    columns = ("url", "family", "authority", "extractor", "document_type")
    both = [sorted(map(str, f(entries, known).select(*columns).collect())) for f, known in ((with_family, FAMILIES), (with_family_table, families))]
    assert both[0] == both[1]
    # Ten thousand more families are one join more rows, not ten thousand cases.
    many = families.unionByName(spark.range(10_000).selectExpr("concat('f', id) AS family", "id + 1000 AS priority", "array(concat('h', id, '.example')) AS hosts", "array(concat('.s', id, '.example')) AS suffixes", "'own' AS default_authority", "NULL AS document_type", "'text' AS default_extractor"))
    began = time.monotonic()
    more = spark.createDataFrame([("https://h77.example/", None, None, None), ("https://a.b.s78.example/", None, None, None)], "url string, family string, authority string, extractor string")
    assert sorted(r["family"] for r in with_family_table(more, many).collect()) == ["f77", "f78"] and time.monotonic() - began < 60


def test_table_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "i int, t string").createOrReplaceTempView("texts")
    assert [tuple(r) for r in spark.sql("SELECT i, pos, part FROM texts, LATERAL chunk_windows(t, 3) ORDER BY i, pos").collect()] == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "g")]
    got = spark.sql("SELECT * FROM page_elements('<h1 id=a>A  b</h1><p>x<b> y</b>', 'p')").collect()
    assert [(r["tag"], r["text"]) for r in got] == [("p", "x y")]
    assert spark.sql("SELECT count(*) FROM page_elements('<h1 id=a>A</h1>')").first()[0] == 4
    for bad in ("SELECT * FROM chunk_windows(3)", "SELECT * FROM chunk_windows('a', 0)", "SELECT * FROM texts, LATERAL chunk_windows(t, i)"):
        with pytest.raises(Exception, match="must be of type|constant number"):
            spark.sql(bad).collect()


def test_seven_bits(spark):
    row = spark.createDataFrame([(bytes([0x63, 0xE9, 0x80, 0xFF, 0x41]),)], "c binary")
    assert row.select(decoded(F.col("c"), F.lit("ascii"))["text"]).first()[0] == "ci\0\x7fA"


def test_urls_normal_and_not(spark):
    cases = {
        "https://a.example/b?c=d#e": "https://a.example/b?c=d", "https://a.example/.b/..c": "https://a.example/.b/..c", "https://a.example/a/../b": "https://a.example/b", "https://a.example/a/%2e%2E/b": "https://a.example/b",
        "https://a.example/a/..": "https://a.example/", "https://a.example": "https://a.example/", "https://a.example/x?y'": "https://a.example/x?y%27", "HTTP://A.example:80/x": "http://a.example/x", "https://a.example/a b": "https://a.example/a%20b",
        "https://a.example/x?/../y": "https://a.example/x?/../y", "https://a.example/x#y z": "https://a.example/x", "mailto:x": "mailto:x",
    }
    rows = spark.createDataFrame(list(cases.items()), "u string, want string")
    made = rows.select("u", "want", normalize_url(F.col("u")).alias("got"))
    assert [tuple(r) for r in made.where("want <> got").collect()] == []
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 40


def test_own_extractors_replace_the_built_in_ones(spark):
    from folio.operators import text_extract
    from folio.operators.extract import extract
    from tests.test_plans import entries, ts

    own = {"html": lambda text, url: text_extract.extracted(F.upper(text), url)}
    docs = extract(entries(spark, [html(page="<p>x"), ("https://h.example/b", "xml", "text/xml", "<r>v</r>")]), ts(), own_extractors=own)
    got = {r["url"][-1]: r["sections"][0]["blocks"][0] for r in docs.collect()}
    assert got["a"]["text"] == "<P>X" and got["b"]["items"] == ["/r/#text: v"]
