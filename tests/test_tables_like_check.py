"""Queries against their SQL over tables with what larger tables hold: URLs that recur, references cut short, documents of one id."""

import duckdb
import pytest

import __spark_entry__

PAGES = [
    (1, "https://a.example/x#one", "<html><head><title>A &amp</title></head><body><article><h1>Cut &amp;&amp;&amp</h1><p>first &copy; &quot</p><p>second &middotx</p></article></body></html>"),
    (2, "https://a.example/x", "<html><head><title>B</title></head><body><article><h1>Other</h1><p>third</p><p>fourth</p></article></body></html>"),
    (3, "https://a.example/x", "<html><head><title>C</title></head><body><article><h1>Third</h1><p>fifth</p></article></body></html>"),
    (4, "http://a.example/x", "<html><head><title>D</title></head><body><article><h1>Fourth</h1><p>sixth</p><p>seventh</p></article></body></html>"),
]
DOCUMENTS = [(1, "one\n\ntwo", "en", "web", 8), (2, "three", "en", "web", 5)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    # Pages of one URL lie in several files.
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def compare(spark, folder, name):
    made = __spark_entry__.queries()[name](spark, folder)
    con = duckdb.connect()
    for table in ("pages", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(made.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in made.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["html_sections", "html_full", "index_document_rows", "manifest_join"])
def test_queries_equal_their_sql(spark, tables, name):
    compare(spark, tables, name)


def test_a_heading_cut_within_a_reference(spark, tmp_path):
    spark.createDataFrame(PAGES[:1], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, str(tmp_path), "index_chunk_rows")


def test_an_entry_stays_one_row(spark):
    from pyspark.sql import functions as F

    from folio.sources.snapshots import snapshot_rows, with_snapshots

    fetched = spark.createDataFrame([("https://a.example/x", None, "text/html", b"1"), ("https://a.example/x#f", None, "text/html", b"2")], "url string, final_url string, content_type string, content binary")
    rows = snapshot_rows(fetched, F.lit("2024-01-01").cast("timestamp"))
    assert with_snapshots(fetched.select("url"), rows).count() == 2


def test_pages_are_dealt_before_the_parser(spark):
    """What moves is pages, not their nodes, and no node is sorted or gathered."""
    from folio.operators.html_extract import extract_pages

    docs = spark.createDataFrame([("<p>x", "u", "generic", "x")], "text string, url string, family string, authority string")
    plan = extract_pages(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")
    assert not any(x in plan for x in ("Window", "Sort", "Aggregate"))


def test_nodes_come_in_small_batches(spark, monkeypatch):
    """The parser holds the nodes of a few pages at once, whatever the size of a batch."""
    from pyspark.sql import functions as F

    from folio.operators import html_nodes

    most = spark.sparkContext.accumulator(0)
    tables = html_nodes.tables

    def counting(pages, node):
        if len(pages) > 3:
            most.add(len(pages))
        return tables(pages, node)

    monkeypatch.setattr(html_nodes, "tables", counting)
    monkeypatch.setattr(html_nodes, "BATCH", 100)
    rows = spark.range(0, 50, 1, 1).select(F.struct("id").alias("own"), F.repeat(F.lit("<p>x"), 10).alias("text"))
    assert html_nodes.nodes_of(rows).where("size(nodes) > 0").count() == 50 and most.value == 0


def test_texts_are_dealt_before_the_parser(spark):
    from folio.operators.xml_extract import extract_texts

    plan = extract_texts(spark.createDataFrame([("<r/>", "u")], "text string, url string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Exchange") and plan.count("Exchange") == 1
    assert not any(x in plan for x in ("Window", "Sort", "Aggregate"))


def test_what_is_found_of_nodes_takes_one_pass(spark):
    """The parser says what hides a node, and all else that is found of nodes is written out once, without a copy of them for each block."""
    from folio.operators.html_extract import extract_pages
    from folio.operators.html_nodes import flat
    from folio.operators.htmltree import parse

    rows = flat(parse("<body><section><ul><li>a</li></ul></section><table><tr><td>b</table>")[0])
    tags = {row[4]: row for row in rows if row[4]}
    assert [tags[t][11] for t in ("section", "ul", "li", "td")] == [-1, tags["section"][0], tags["ul"][0], tags["table"][0]]
    assert [t for t, row in tags.items() if row[12]] == ["tr"]
    docs = spark.createDataFrame([("<p>x", "u", "generic", "x")], "text string, url string, family string, authority string")
    plan = extract_pages(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" AS n#") == 1 and " AS nodes#" not in plan and " AS part" not in plan


#: Texts without words, and such as end in what ends a line for Java but isn't white space here.
ENDS = [(1, "one\n\ntwo"), (2, ""), (3, " \n\n\t\n\n "), (4, "a \u0085"), (5, "\u0085"), (6, "b\n\n　"), (7, "\r\n\r\n")]


@pytest.fixture(scope="module")
def ends(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("ends"))
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in ENDS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(PAGES[:1], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def test_markdown_of_texts_without_words_equals_its_sql(spark, ends):
    compare(spark, ends, "render_markdown")


def test_markdown_ends_in_one_line_end(spark, ends):
    """The contract's form still trims white space."""
    from folio.operators.render import markdown
    from folio.plans.queries import text_documents

    got = {int(r["url"].rsplit("/", 1)[1]): r["markdown"].split("## Document", 1)[1] for r in markdown(text_documents(spark, ends)).collect()}
    assert got == {1: "\n\none\n\ntwo\n", 2: "\n", 3: "\n", 4: "\n\na \u0085\n", 5: "\n\n\u0085\n", 6: "\n\nb\n", 7: "\n"}


def test_markdown_files_of_texts_without_words_equal_their_sql(spark, ends):
    compare(spark, ends, "markdown_files")


@pytest.mark.parametrize("name", ["json_mixed", "markdown_files"])
def test_files_are_listed_by_the_tasks(spark, ends, name):
    """The plan names no file, however many there are."""
    made = __spark_entry__.queries()[name](spark, ends)
    assert made.inputFiles() == [] and "FileScan" not in made._jdf.queryExecution().executedPlan().toString()
    compare(spark, ends, name)
