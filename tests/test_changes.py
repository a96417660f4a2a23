"""The stream of section changes ends, in any order of arrival, where a batch over the latest snapshots ends."""

import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.diff import digests
from folio.operators.extract import extract
from folio.streaming import changes
from folio.streaming.incremental import entries_of
from tests.test_plans import snapshot_table, ts


def test_any_order_ends_with_the_batch(spark, tmp_path):
    r = random.Random(1)
    versions = []
    for day in range(1, 5):
        pages = [(f"https://h.example/{u}", "".join(f"<h2 id=s{i}>T</h2><p>{r.choice('abc')}</p>" for i in range(4) if r.random() < 0.8)) for u in range(4) if r.random() < 0.8]
        versions.append(snapshot_table(spark, pages, f"2024-01-0{day}"))
    order = r.sample(range(4), 4)
    for place, version in enumerate(order):
        versions[version].write.mode("append").parquet(f"{tmp_path}/in")
        if place in (1, 3):
            changes.start_digests(spark, f"{tmp_path}/in", f"{tmp_path}/digests", f"{tmp_path}/c1", ts()).awaitTermination(300)
            changes.start_changes(spark, f"{tmp_path}/digests", f"{tmp_path}/out", f"{tmp_path}/c2", files_a_batch=4).awaitTermination(300)
    out = spark.read.parquet(f"{tmp_path}/out")
    got = sorted(map(tuple, changes.applied(out).collect()))
    rows = reduce(DataFrame.unionByName, versions)
    last = rows.join(rows.groupBy("source_url").agg(F.max("fetched_at").alias("fetched_at")), ["source_url", "fetched_at"]).select(*rows.columns)
    want = sorted((x["url"], s[64:], s[:64]) for x in digests(extract(entries_of(last), ts(), extractors=("html",))).collect() for s in x["sections"])
    assert got == want and got
    # A change says what it is of: a known section is changed or removed, a new one added.
    state = {}
    for row in sorted(out.collect(), key=lambda x: (x["url"], x["number"])):
        key = row["url"], row["section_id"]
        assert (row["kind"] == "added") == (key not in state) and (row["kind"] != "changed" or state[key] != row["hash"])
        state.pop(key, None)
        if row["kind"] != "removed":
            state[key] = row["hash"]


def test_states_that_are_forgotten_need_a_running_query(spark, tmp_path):
    with pytest.raises(ValueError, match="running"):
        changes.start_changes(spark, f"{tmp_path}/digests", f"{tmp_path}/out", f"{tmp_path}/c", forget_ms=1000)


def test_states_meet_their_batch_without_python(spark, tmp_path, monkeypatch):
    """Late, repeated and unchanged snapshots, over states that are kept whole in every second batch only."""
    monkeypatch.setattr(changes, "FULL", 2)
    section = lambda text, name: text * 64 + name
    batches = [
        [("u", "2024-01-02", "b", [section("1", "x"), section("1", "y")]), ("v", "2024-01-01", "a", [section("1", "x")])],
        [("u", "2024-01-01", "a", [section("9", "z")]), ("u", "2024-01-03", "c", [section("2", "x"), section("1", "w")]), ("u", "2024-01-03", "c", [section("2", "x"), section("1", "w")])],
        [("u", "2024-01-04", "d", [section("2", "x"), section("1", "w")]), ("u", "2024-01-05", "e", [])],
        [("v", "2024-01-02", "b", [section("2", "x")]), ("u", "2024-01-05", "e", [section("9", "z")])],
    ]
    for number, rows in enumerate(batches):
        table = spark.createDataFrame(rows, "url string, day string, snapshot_id string, sections array<string>").withColumn("fetched_at", F.to_timestamp("day"))
        table.withColumn("digest", F.lit("")).select("url", "snapshot_id", "fetched_at", "digest", "sections").coalesce(1).write.parquet(f"{tmp_path}/digests/batch={number}")
        changes.start_changes(spark, f"{tmp_path}/digests", f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(300)
    got = sorted(tuple(x[c] for c in ("url", "number", "snapshot_id", "previous_id", "kind", "section_id")) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [
        ("u", 1, "b", None, "added", "x"), ("u", 1, "b", None, "added", "y"), ("u", 2, "c", "b", "added", "w"), ("u", 2, "c", "b", "changed", "x"), ("u", 2, "c", "b", "removed", "y"),
        ("u", 4, "e", "d", "removed", "w"), ("u", 4, "e", "d", "removed", "x"), ("v", 1, "a", None, "added", "x"), ("v", 2, "b", "a", "changed", "x"),
    ]
    states = changes.read_states(spark, f"{tmp_path}/c/states", 4)
    assert {x["url"] for x in states.collect()} == {"u", "v"}
    assert changes.read_states(spark, f"{tmp_path}/c/states", 4, 1 << 60).isEmpty()
    plan = changes.stepped(spark.read.schema(changes.DIGESTS).parquet(f"{tmp_path}/digests"), states, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
