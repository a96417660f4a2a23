"""Chunks that are kept up to date: only changed files are read again."""

import os
import time

from folio.operators.chunk import chunks
from folio.sources import chunk_store
from folio.sources.documents import read_documents, write_documents
from tests.test_plans import docs_of


def test_only_changed_files_are_read(spark, tmp_path):
    def write(pages):
        docs = docs_of(spark, *[(f"https://h.example/{u}", "text", "text/plain", t) for u, t in pages])
        write_documents(docs, f"{tmp_path}/in", "json")

    def same():
        names = ("chunk_id", "text", "path")
        want = chunks(read_documents(spark, f"{tmp_path}/in", "json")).select(*names)
        assert sorted(map(tuple, chunk_store.all_chunks(spark, f"{tmp_path}/out").select(*names).collect())) == sorted(map(tuple, want.collect()))

    update = lambda: chunk_store.update(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    name = lambda files: [f.rsplit("/", 1)[1] for f in files]
    write([(i, f"text {i}\n\nmore") for i in range(6)])
    first = update()
    assert len(first.read) == 6
    same()
    assert update() == chunk_store.Update([], [])
    time.sleep(1.1)
    write([(3, "another text")])
    got = update()
    assert name(got.read) == ["h-example-3.json"] and got.gone == []
    same()
    # A file that is only touched is looked at, not chunked; one that is gone takes its chunks along, one without blocks too.
    folder = f"{tmp_path}/in/generic"
    os.utime(f"{folder}/h-example-1.json")
    os.remove(f"{folder}/h-example-2.json")
    time.sleep(1.1)
    write([(4, " "), (9, "new")])
    got = update()
    assert name(got.read) == ["h-example-4.json", "h-example-9.json"] and name(got.gone) == ["h-example-2.json"]
    same()
    assert update() == chunk_store.Update([], [])


def test_the_driver_holds_no_names(spark, tmp_path, monkeypatch):
    """Updates list and read files in the tasks: nothing that is collected grows with their number."""
    docs = docs_of(spark, *[(f"https://h.example/{i}", "text", "text/plain", f"text {i}") for i in range(200)])
    write_documents(docs, f"{tmp_path}/in", "json")
    collected, collect = [], type(docs).collect

    def counting(df):
        rows = collect(df)
        collected.append(len(rows))
        return rows

    monkeypatch.setattr(type(docs), "collect", counting)
    got = chunk_store.update(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert max(collected) <= chunk_store.BUCKETS
    assert got.counts() == (200, 0) and chunk_store.all_chunks(spark, f"{tmp_path}/out").count() == 200


def test_a_folder_of_json_is_listed_by_the_tasks(spark, tmp_path):
    """The plan names no file, however many there are; hidden files count, a single file and a pattern go through Spark's reader."""
    from folio.sources.documents import read_documents

    one = '{"schemaVersion": "0.2", "url": "https://a.example/%s", "title": "t", "family": "generic", "extractedAt": "2024-01-01T00:00:00.000Z", "sections": [{"heading": "h", "level": 1, "blocks": []}], "warnings": []}'
    for name in ("a.json", "deep/er/b.json", "_own/c.json", ".d.json", "e.json.part", "f.JSON"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(one % name)
    for path in (f"{tmp_path}/in", f"{tmp_path}/in/", f"file://{tmp_path}/in"):
        docs = read_documents(spark, path, "json")
        assert "FileScan" not in docs._jdf.queryExecution().executedPlan().toString() and docs.inputFiles() == []
        assert sorted(r["url"].removeprefix("https://a.example/") for r in docs.collect()) == [".d.json", "_own/c.json", "a.json", "deep/er/b.json"]
    for path in (f"{tmp_path}/in/a.json", f"{tmp_path}/i?/a.json", f"file:{tmp_path}/in/a.json"):
        assert [r["url"] for r in read_documents(spark, path, "json").collect()] == ["https://a.example/a.json"]
    (tmp_path / "none").mkdir()
    assert read_documents(spark, f"{tmp_path}/none", "json").count() == 0
