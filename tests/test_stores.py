"""The trigram index, digest tables, the snapshot store and fetching as a data source."""

import json
import os
import subprocess
import sys
import textwrap
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio import cli
from folio.operators import html_extract
from folio.operators.diff import diff_digests, diff_documents, digests, save_digests
from folio.operators.index import query_index
from folio.operators.postings import BUCKETS, candidates, grams_of, search_index, stored_rows, write_index
from folio.sources import fetching, snapshot_store
from tests.test_plans import docs_of, html, snapshot_table, ts

ROWS = [
    (i, f"h{i % 7}", f"https://e.example/{i}", ["generic", "w3c"][i % 2], text)
    for i, text in enumerate(["The Café", "a thé", "", None, "naïve THE", "xyzzy", "100% sure", "İstanbul", "straße", "tab\tend", "the " * 200, "𝒳yz"] * 20)
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rows = spark.createDataFrame(ROWS, "doc_order long, heading string, url string, family string, text_preview string").repartition(3)
    write_index(rows, path)
    return rows, path


@pytest.mark.parametrize("term", ["the", "THE c", "é", "xy", "", "%", "h1 https://e.example/1", "zzz", "nowhere", "i̇st", "STRASSE", "ß", "𝒳yz", "d\te"])
def test_search_equals_the_scan(spark, index, term):
    rows, path = index
    # One family where the term has an even length; candidates broadcast, or joined by shuffle.
    family, few = [None, "w3c"][len(term) % 2 == 0], [0, 10_000][len(term) % 3 > 0]
    found = search_index(spark, path, term, family, few=few)
    assert found.columns == rows.columns
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, query_index(rows, term, family).collect()))


def test_search_reads_only_its_buckets(spark, index):
    _, path = index
    found, most = candidates(spark, path, "xyzzy")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters" in plan and most == 20
    read = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(grams_of("xyzzy")) == 3 and len(read) <= BUCKETS
    # Lists are sorted, of distinct rows, and never longer than a segment.
    lists = spark.read.parquet(f"{path}/grams")
    assert lists.where("places <> sort_array(array_distinct(places)) or n <> size(places)").isEmpty()
    assert stored_rows(spark, path).select("row").distinct().count() == len(ROWS)
    with pytest.raises(TypeError):
        search_index(spark, path, 3)


def test_lists_are_made_a_batch_at_a_time():
    """Each trigram of a few batches is one row a segment, with the places of its rows, whatever their characters."""
    from folio.operators import postings

    texts = ["abcabc", "ab", "", "z\u00e4abc\U0001F600x", "abc", "abcd", "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))]
    rows = pa.table({"segment": pa.array([0, 0, 0, 0, 0, 1, 1], pa.int64()), "place": pa.array([5, 6, 7, 8, 9, 0, 1], pa.int32()), "folded": [t.encode() for t in texts[:5]] + [texts[5].encode() + b"\xff", texts[6].encode()]})
    texts[5] += "\ufffd"
    want = {}
    for segment, place, text in zip(rows["segment"].to_pylist(), rows["place"].to_pylist(), texts, strict=True):
        for gram in grams_of(text):
            want.setdefault((gram, segment), []).append(place)
    made = [x for batch in postings.listed(rows.to_batches(max_chunksize=2)) for x in batch.to_pylist()]
    assert len(made) == len(want) and {(x["gram"], x["segment"]): x["places"] for x in made} == want
    with pytest.raises(OverflowError):
        postings.lists_of(["".join(map(chr, range(0x10000, 0x40000))), *["abc"] * 1999], np.arange(2000))


def test_an_empty_index(spark, index, tmp_path):
    rows, _ = index
    write_index(rows.limit(0), f"{tmp_path}/none")
    for term in ("the", "t"):
        found = search_index(spark, f"{tmp_path}/none", term)
        assert found.count() == 0 and found.columns == rows.columns


def test_digest_tables_need_no_exchange(spark, tmp_path):
    page = "<h1 id=a>A</h1><p>x</p><h1 id=b>B</h1><p>y</p><h1 id=b>B</h1><p>z</p>"
    old = docs_of(spark, html(page=page), html("https://h.example/b"), html("https://h.example/c", "<h1>only</h1>"))
    new = docs_of(spark, html(page=page.replace("z", "w").replace("id=a", "id=n")), html("https://h.example/b"))
    tables = []
    for name, docs in (("digests_old", old), ("digests_new", new)):
        save_digests(docs, name, f"{tmp_path}/{name}", buckets=4)
        tables.append(spark.table(name))
    out = diff_digests(*tables, ts())
    # As for tables too large to be broadcast.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = diff_digests(*tables, ts())._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = diff_documents(old, new, ts())
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    got = {r["url"][-1]: r for r in out.collect()}
    assert (got["a"]["added"], got["a"]["removed"], got["a"]["changed"]) == (["n"], ["a"], ["b"]) and tuple(got["b"]["summary"]) == (0, 0, 0) and len(got) == 2
    # The digest says whether anything counts: the order of the document's sections doesn't.
    assert digests(old).where("url like '%b'").first()["digest"] == digests(new).where("url like '%b'").first()["digest"]


def test_the_store_writes_what_changed(spark, tmp_path):
    path = f"{tmp_path}/store"
    urls = [f"https://h.example/{i}" for i in range(200)]
    first = snapshot_table(spark, [(u, f"page {i % 5}") for i, u in enumerate(urls)], "2024-01-01")
    snapshot_store.upsert(spark, path, first)
    files = lambda name: {f: f.stat().st_mtime_ns for f in Path(path, name).rglob("*.parquet")}
    before = files("latest")
    assert spark.read.parquet(f"{path}/contents").count() == 5
    for _ in range(2):  # the second time changes nothing
        snapshot_store.upsert(spark, path, snapshot_table(spark, [(urls[3], "new"), (urls[4] + "#x", "page 1")], "2024-02-01"))
    after = files("latest")
    touched = {f.parent.name for f in before if f not in after}
    assert 1 <= len(touched) <= 2 and all(after[f] == t for f, t in before.items() if f in after)
    assert spark.read.parquet(f"{path}/contents").count() == 6
    index = {r["url"]: r for r in snapshot_store.index_of(spark, path).collect()}
    assert len(index) == 200 and [len(index[u]["history"]) for u in urls[2:5]] == [1, 2, 2] and index[urls[3]]["latest"] == index[urls[3]]["history"][-1]
    manifest = spark.createDataFrame([(urls[3],), (urls[7],), (urls[4] + "#y",)], "url string")
    got = {r["url"]: bytes(r["content"]) for r in snapshot_store.with_latest(manifest, path).collect()}
    assert got == {urls[3]: b"new", urls[7]: b"page 2", urls[4] + "#y": b"page 1"}
    with pytest.raises(ValueError, match="nobody"):
        snapshot_store.with_latest(spark.createDataFrame([("https://nobody.example/",)], "url string"), path)


def test_fetching_deals_by_host(spark, tmp_path):
    urls = spark.createDataFrame([(f"https://big.example/{i % 90}",) for i in range(100)] + [(f"https://h{i}.example/",) for i in range(10)] + [("no url",)], "url string")
    fetching.write_jobs(urls, str(tmp_path), urls_a_task=20)
    jobs = spark.read.parquet(f"{tmp_path}/jobs").withColumn("file", F.input_file_name())
    assert jobs.count() == 101 and jobs.select("url").distinct().count() == 101
    assert jobs.where("host = 'big.example'").select("parts").distinct().collect()[0][0] == 5
    assert jobs.where("host = 'big.example'").select("file").distinct().count() > 1


def test_fetching_retries_and_quarantines(spark, tmp_path):
    log = str(tmp_path / "log")

    def get(url, timeout):
        with open(log, "a") as file:
            file.write(url + "\n")
        with open(log) as file:
            turns = file.read().split("\n").count(url)
        if url.endswith("down") or (url.endswith("slow") and turns < 3):
            raise OSError("refused")
        if url.endswith("bad"):
            raise ValueError("no page")
        return url, "text/html", b"x"

    urls = spark.createDataFrame([(f"https://h.example/{x}",) for x in ("fine", "slow", "down", "bad")], "url string")
    for _ in range(2):  # the second time nothing is asked
        got = {r["url"][-4:]: r["error"] for r in fetching.fetch_all(urls, f"{tmp_path}/f", get, quarantine=True, retries=2, pause=0.01).collect()}
        assert got == {"fine": None, "slow": None, "down": "refused", "/bad": "no page"}
    asked = Counter(x.rsplit("/", 1)[1] for x in Path(log).read_text().split())
    assert asked == {"fine": 1, "slow": 3, "down": 3, "bad": 1}
    with pytest.raises(Exception, match="no page"):
        fetching.fetch_all(urls, f"{tmp_path}/g", get, retries=0).collect()


KILLED = """
    import os, sys
    from pyspark.sql import SparkSession
    from folio.sources.fetching import fetch_all

    folder = sys.argv[1]
    spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

    def get(url, timeout):
        with open(f"{folder}/log", "a") as file:
            file.write(url + "\\n")
        return url, "text/html", url.encode()

    def fatal(url, timeout):
        if url.endswith("a/7"):
            try:
                os.mkdir(f"{folder}/killed")
            except FileExistsError:
                pass
            else:
                os._exit(1)
        return get(url, timeout)

    urls = spark.createDataFrame([(f"https://{h}.example/{h}/{i}",) for h in "ab" for i in range(20)], "url string")
    print(fetch_all(urls, f"{folder}/f", fatal, urls_a_task=25).where("content is not null").count())
"""


def test_a_killed_task_asks_for_nothing_twice(tmp_path):
    """Of two hosts every URL is asked for once, though the process that fetches one of them dies on the way."""
    root = str(Path(__file__).parent.parent)
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(KILLED), str(tmp_path)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": root})
    assert done.stdout.split()[-1] == "40", done.stderr[-2000:]
    asked = Counter(Path(tmp_path, "log").read_text().split())
    assert (tmp_path / "killed").exists() and len(asked) == 40 and set(asked.values()) == {1}


def test_one_parse_a_page(spark, monkeypatch):
    """Whatever is asked of the sections and blocks of pages, each page is parsed once."""
    from folio.operators.chunk import chunks
    from folio.operators.index import index_chunks

    parsed = spark.sparkContext.accumulator(0)
    tables = html_extract.nodes_of.__globals__["tables"]

    def counting(pages, node):
        parsed.add(len(pages))
        return tables(pages, node)

    monkeypatch.setitem(html_extract.nodes_of.__globals__, "tables", counting)
    docs = docs_of(spark, *[html(f"https://h.example/{i}") for i in range(9)])
    for made in (docs.select(F.explode_outer("sections").alias("s")).where("s is not null"), index_chunks(chunks(docs)), query_index(index_chunks(chunks(docs)), "first")):
        before = parsed.value
        made.write.format("noop").mode("overwrite").save()
        assert parsed.value - before == 9


def test_an_index_may_be_made_again(spark, tmp_path, capsys):
    docs = docs_of(spark, html())
    docs.write.partitionBy("family").parquet(f"{tmp_path}/specs")
    run = lambda *args: cli.main(list(args), spark)
    for _ in range(2):
        assert run("chunk", "--input", f"{tmp_path}/specs", "--out", f"{tmp_path}/chunks") == 0
        assert run("index", "--chunks", f"{tmp_path}/chunks") == 0
        assert run("index", "--chunks", f"{tmp_path}/chunks") == 0
    capsys.readouterr()
    assert run("query", "--index", f"{tmp_path}/chunks-index", "--term", "first", "--format", "json") == 0
    out = capsys.readouterr().out
    made = json.loads(out)
    assert out.startswith('[\n  {\n    "chunkId"') and [x["chunkId"] for x in made] == ["h-example-a::top::p1"]
