"""Documents, chunks, index, diff, rendering, sources and the command line on small tables."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from folio import cli
from folio.operators.chunk import chunks
from folio.operators.diff import diff_documents
from folio.operators.extract import extract, output_path
from folio.operators.fragment import filter_by_fragment
from folio.operators.index import index_chunks, index_documents, query_index
from folio.operators.render import markdown
from folio.plans import pipeline
from folio.sources import snapshots as snap
from folio.sources.documents import contract_json, invalid_documents, read_documents, write_documents
from folio.sources.manifest import load_manifest
from folio.streaming import incremental



PAGE = "<title>Page</title><h1 id='top'>Head</h1><p id='p1'>First text</p><ul><li>a<li>b</ul><pre>x = 1</pre><h2 id='two'>Two</h2><table><tr><th>A</th></tr><tr><td>1</td></tr></table><dl><dt>t<dd>d</dl><blockquote>q</blockquote>"
def ts():
    return F.lit("2024-05-06 07:08:09.5").cast("timestamp")


def entries(spark, rows):
    schema = "doc_seq long, url string, family string, authority string, extractor string, content_type string, charset string, content binary, snapshot_id string"
    return spark.createDataFrame([(i, u, None, None, e, k, None, c if isinstance(c, bytes) else c.encode(), f"s{i}") for i, (u, e, k, c) in enumerate(rows)], schema)


def docs_of(spark, *rows):
    return extract(entries(spark, rows), ts())


def html(url="https://h.example/a", page=PAGE):
    return (url, None, "text/html", page)


def test_routes_and_warnings(spark):
    rows = [
        html(), ("https://h.example/b", "text", "text/plain", "a\r\n\r\nb  c\n \nd"), ("https://h.example/c", "xml", "text/xml", "<r>v</r>"), ("https://h.example/d", "pdf", "application/pdf", b"no"),
        ("https://h.example/e", None, "image/png", "x"), ("https://h.example/f", "odd", "text/html", "x"),
    ]
    got = {r["url"][-1]: r for r in docs_of(spark, *rows).collect()}
    assert [b["text"] for b in got["b"]["sections"][0]["blocks"]] == ["a", "b c d"] and got["b"]["title"] == "https://h.example/b"
    assert got["c"]["sections"][0]["blocks"][0]["items"] == ["/r/#text: v"]
    assert got["d"]["warnings"] == ["PDF extraction failed: no PDF header"]
    assert got["e"]["warnings"] == ['Unsupported content type for extractor "html"'] and got["f"]["warnings"] == ['Unsupported content type for extractor "odd"']
    assert got["e"]["sections"] == [] and got["a"]["title"] == "Page"


def test_fragments(spark):
    found = lambda f: filter_by_fragment(docs_of(spark, html()).withColumn("url", F.lit(f"https://h.example/a#{f}"))).first()
    assert [s["id"] for s in found("two")["sections"]] == ["two"]
    assert [[b["id"] for b in s["blocks"]] for s in found("p1")["sections"]] == [["p1"]]
    assert found("none")["warnings"] == ["Fragment not found: none"] and len(found("none")["sections"]) == 2
    assert len(found("")["sections"]) == 2


def test_chunks_and_index(spark):
    made = chunks(docs_of(spark, html(), html("https://h.example/b", PAGE.replace("First", "Other"))))
    got = {r["chunk_id"]: r for r in made.collect()}
    assert got["h-example-a::two::block-1"]["text"] == "A 1" and got["h-example-a::two::block-2"]["text"] == "t: d"
    assert got["h-example-a::top::block-2"]["text"] == "a b" and got["h-example-a::top::p1"]["fragment"] == "#p1"
    index = index_chunks(made)
    assert index.count() == len(got) == 12
    hits = query_index(index, "HEAD HTTPS://h.example/A first").collect()
    assert [h["chunk_id"] for h in hits] == ["h-example-a::top::p1"]
    assert query_index(index, "first", "w3c").count() == 0
    with pytest.raises(TypeError):
        query_index(index, True)
    lists = {r["doc_id"]: r["chunks"] for r in index_documents(made).collect()}
    assert lists["h-example-a"] == [c for c in ("h-example-a::top::p1", "h-example-a::top::block-2", "h-example-a::top::block-3", "h-example-a::two::block-1", "h-example-a::two::block-2", "h-example-a::two::block-3")]


def test_last_writer_of_a_path(spark):
    rows = index_chunks(chunks(docs_of(spark, html(page="<h1 id=s>T</h1><p id=x>one</p><p id=x>two</p>")))).collect()
    assert {r["text_preview"] for r in rows} == {"two"} and len({r["text_hash"] for r in rows}) == 2


@pytest.mark.parametrize("partitions", [1, 5])
def test_diff(spark, partitions):
    old = docs_of(spark, html(page="<h1 id=a>A</h1><p>x</p><h1 id=b>B</h1><p>y</p><h1>C</h1><p>z</p>"), html("https://h.example/b"), html("https://h.example/old"))
    new = docs_of(spark, html(page="<h1 id=a>New</h1><p>x</p><h1 id=d>D</h1><p>y</p><h1>C</h1><p>z!</p>"), html("https://h.example/b"))
    got = {r["url"][-1]: r for r in diff_documents(old.repartition(partitions), new.repartition(partitions), ts()).collect()}
    assert (got["a"]["added"], got["a"]["removed"], got["a"]["changed"]) == (["d"], ["b"], ["section-3"])
    assert tuple(got["b"]["summary"]) == (0, 0, 0) and set(got) == {"a", "b"} and got["a"]["changed_at"] == "2024-05-06T07:08:09.500Z"


def test_markdown(spark):
    text = markdown(docs_of(spark, html())).first()["markdown"]
    assert text.startswith("# Page\n\nURL: https://h.example/a\nFamily: generic\nAuthority: informative\nSnapshot: s0\nExtracted: 2024-05-06T07:08:09.500Z\n\n## Head\n\nID: top\n\nFirst text\n\n- a\n- b\n\n```\nx = 1\n```\n")
    assert text.endswith("## Two\n\nID: two\n\n| A |\n| --- |\n| 1 |\n\n- t: d\n\n> q\n")


def test_output_path(spark):
    row = spark.createDataFrame([(None,), ("x",), ("/abs/y.json",)], "o string")
    got = [r["p"] for r in row.select(output_path(F.col("o"), F.lit("w3c"), F.lit("https://h.example/a")).alias("p")).collect()]
    assert got == ["specs/w3c/h-example-a.json", "specs/x.json", "/abs/y.json"]


def test_documents_round_trip(spark, tmp_path):
    docs = docs_of(spark, html(), ("https://h.example/b", "text", "text/plain", "t"))
    for fmt in ("json", "parquet"):
        write_documents(docs, f"{tmp_path}/{fmt}", fmt)
        back = read_documents(spark, f"{tmp_path}/{fmt}", fmt)
        assert sorted(map(str, back.select("url", "sections", "title").collect())) == sorted(map(str, docs.select("url", "sections", "title").collect()))
    assert invalid_documents(docs).count() == 0
    assert invalid_documents(docs.withColumn("title", F.lit(None).cast("string"))).count() == 2
    made = json.loads(contract_json(docs.where("url like '%a'")).first()["json"])
    assert made["schemaVersion"] == "0.2" and made["sections"][1]["blocks"][1]["items"] == [{"term": "t", "definition": "d"}]


def snapshot_table(spark, rows, ts, manual=False):
    fetched = spark.createDataFrame([(u, None, "text/html", c.encode(), "/x.html") for u, c in rows], "url string, final_url string, content_type string, content binary, local_path string")
    return snap.snapshot_rows(fetched, F.lit(ts).cast("timestamp"), manual)


def test_snapshots(spark):
    first = snapshot_table(spark, [("https://h.example/a#x", "1"), ("https://h.example/b", "2")], "2024-01-01")
    second = snapshot_table(spark, [("https://h.example/a", "3")], "2024-02-01")
    both = first.unionByName(second)
    index = {r["url"][-1]: r for r in snap.snapshot_index(both).collect()}
    assert len(index["a"]["history"]) == 2 and index["a"]["latest"] == index["a"]["history"][-1] == second.first()["snapshot_id"]
    manifest = spark.createDataFrame([("https://h.example/a#y",), ("https://h.example/c",)], "url string")
    assert [r["url"] for r in snap.to_fetch(manifest, both, reuse=True).collect()] == ["https://h.example/c"]
    with pytest.raises(ValueError, match="h.example/c"):
        snap.with_snapshots(manifest, both)
    assert bytes(snap.with_snapshots(manifest.limit(1), both).first()["content"]) == b"3"
    files = spark.createDataFrame([(u, None, "text/html", c, "/x.html") for u, c in [("https://h.example/a", b"3"), ("https://h.example/b", b"new"), ("https://h.example/d", b"4")]], "url string, final_url string, content_type string, content binary, local_path string")
    count = lambda **kw: sorted(r["source_url"][-1] for r in snap.manual_ingest(files, both, ts(), **kw).collect())
    assert (count(), count(reuse=True), count(refresh=True), count(refresh=True, reuse=True)) == (["a", "b", "d"], ["d"], ["b", "d"], ["b", "d"])


def test_fetch(spark):
    def get(url, timeout):
        if url.endswith("bad"):
            raise OSError("refused")
        return url, "text/html", b"<p>x</p>"

    urls = spark.createDataFrame([("https://h.example/ok",), ("https://h.example/bad",)], "url string")
    rows = {r["url"][-3:]: r for r in snap.fetch(urls, get, quarantine=True).collect()}
    assert rows["bad"]["error"] == "refused" and rows["/ok"]["content_type"] == "text/html"
    with pytest.raises(Exception, match="refused"):
        snap.fetch(urls, get).collect()


def test_manifest(spark, tmp_path):
    good, bad = tmp_path / "m.json", tmp_path / "b.json"
    good.write_text('[{"url": "https://h.example/a", "family": ""}, {"family": "w3c"}, {"url": "https://h.example/b", "label": "L", "more": 1}]')
    bad.write_text('{"url": "x"}')
    assert [(r["url"], r["family"], r["label"]) for r in load_manifest(spark, str(good)).orderBy("doc_seq").collect()] == [("https://h.example/a", None, None), ("https://h.example/b", None, "L")]
    with pytest.raises(ValueError):
        load_manifest(spark, str(bad))


def test_pipeline_and_commands(spark, tmp_path, capsys):
    page = tmp_path / "page.html"
    page.write_text(PAGE)
    (tmp_path / "map.json").write_text(json.dumps([{"sourceUrl": "https://h.example/a", "localPath": str(page), "contentType": "text/html"}]))
    (tmp_path / "manifest.json").write_text('[{"url": "https://h.example/a"}]')
    path = lambda x: f"{tmp_path}/{x}"
    run = lambda *args: cli.main(list(args), spark)
    for _ in range(2):
        assert run("manual-ingest", "--map", path("map.json"), "--snapshots", path("snap"), "--refresh") == 0
    assert spark.read.parquet(path("snap")).count() == 1
    run("extract", "--manifest", path("manifest.json"), "--snapshots", path("snap"), "--out", path("specs"))
    run("extract", "--manifest", path("manifest.json"), "--snapshots", path("snap"), "--out", path("md"), "--format", "md")
    run("chunk", "--input", path("specs"), "--out", path("chunks"))
    run("index", "--chunks", path("chunks"), "--out", path("index"))
    run("diff", "--from", path("specs"), "--to", path("specs"), "--out", path("diff"))
    capsys.readouterr()
    assert run("query", "--index", path("index"), "--term", "FIRST") == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["chunk_id"] == "h-example-a::top::p1"
    assert spark.read.json(path("diff")).count() == 1 and (tmp_path / "md/generic/h-example-a.md").read_text().startswith("# Page")
    run("extract", "--manifest", path("manifest.json"), "--snapshots", path("snap"), "--out", path("json"), "--format", "json")
    written = (tmp_path / "json/generic/h-example-a.json").read_text()
    assert written.startswith('{\n  "schemaVersion": "0.2",\n  "url"') and written.endswith("}\n") and list((tmp_path / "json/generic").iterdir()) == [tmp_path / "json/generic/h-example-a.json"]
    run("chunk", "--input", path("json"), "--format", "json", "--out", path("json-chunks"))
    assert spark.read.parquet(path("json-chunks")).count() == 6
    (tmp_path / "families.json").write_text('[{"id": "mine", "hosts": ["h.example"], "authority": "normative", "prune": [".x"]}, {"hosts": ["no"]}]')
    run("extract", "--manifest", path("manifest.json"), "--snapshots", path("snap"), "--out", path("own"), "--families", path("families.json"))
    assert spark.read.parquet(path("own")).select("family", "authority").first() == ("mine", "normative")
    result = pipeline.run(load_manifest(spark, path("manifest.json")), spark.read.parquet(path("snap")), ts(), path("all"))
    assert (result.documents.count(), result.index.count(), result.index_documents.count()) == (1, 6, 1)
    assert run() == 0 and run("nonsense") == 1


def test_stream(spark, tmp_path):
    rows = snapshot_table(spark, [("https://h.example/a", PAGE)], "2024-01-01")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        incremental.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", ts()).awaitTermination(120)
        rows.write.mode("append").parquet(f"{tmp_path}/in")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_registered_queries():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 35
