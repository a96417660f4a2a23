"""Section changes as snapshots arrive: a stream with state, one small state a URL.

Snapshots come in any order.  A first stream extracts what arrived and keeps, of
each snapshot, its digests (:func:`folio.operators.diff.digests`).  A second one
remembers for each URL the sections of the newest snapshot that it has seen, and
gives out what a newer one adds, removes and changes; an older one, that comes
late, changes nothing.  Applied in their order, the changes lead to the sections
of the latest snapshots, as a batch over all of them finds them.

The states are a table below the checkpoint, a folder a batch with those of its
URLs, every :data:`FULL` batches one with all; a batch meets them in one window by
URL.  A processor in Python with a state store takes milliseconds a URL instead.

States that saw no snapshot for ``forget_ms`` are dropped; the URL then starts anew.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from folio.operators.diff import HASH, digests
from folio.operators.extract import extract
from folio.sources.snapshots import SCHEMA
from folio.streaming.incremental import entries_of

CHANGES = "url string, number long, snapshot_id string, previous_id string, kind string, section_id string, hash string"
DIGESTS = "url string, snapshot_id string, fetched_at timestamp, digest string, sections array<string>"
STATE = "url string, fetched_at timestamp, snapshot_id string, number long, sections array<string>, seen_ms long"
#: Every so many batches all states are written.
FULL = 16


def section_changes(old: str, new: str) -> Column:
    """``kind``, ``section_id`` and ``hash`` of what a newer list of sections adds, changes and removes."""
    ids = lambda entries: f"transform({entries}, x -> substr(x, {HASH + 1}))"
    come, gone = f"array_except({new}, {old})", f"array_except({old}, {new})"
    kind = f"if(array_contains({ids(gone)}, substr(e, {HASH + 1})), 'changed', 'added')"
    there = f"transform({come}, e -> named_struct('kind', {kind}, 'section_id', substr(e, {HASH + 1}), 'hash', substr(e, 1, {HASH})))"
    lost = f"transform(array_except({ids(gone)}, {ids(come)}), i -> named_struct('kind', 'removed', 'section_id', i, 'hash', CAST(NULL AS string)))"
    return F.expr(f"concat({there}, {lost})")


def stepped(rows: DataFrame, states: DataFrame, now_ms: int) -> DataFrame:
    """Digests and the states before them, by URL: a row for each newer snapshot with its ``changes``, and the state that is ``last``.

    ``number`` counts a URL's snapshots that were newer; ``touched`` is a URL of which there are digests, newer or not.
    """
    come = rows.select("url", "fetched_at", "snapshot_id", F.lit(None).cast("long").alias("number"), "sections", F.lit(now_ms).cast("long").alias("seen_ms"), F.lit(None).cast("long").alias("batch"))
    each, order = Window.partitionBy("url"), ["fetched_at", "snapshot_id", F.col("batch").desc_nulls_last(), "sections"]
    w, at = each.orderBy(*order), F.struct("fetched_at", "snapshot_id")
    both = come.unionByName(states).withColumns({"newest": F.max("batch").over(each), "touched": F.max(F.col("batch").isNull()).over(each), "seen_ms": F.max("seen_ms").over(each)})
    both = both.where("batch IS NULL OR batch = newest").withColumn("known", F.max(F.when(F.col("batch").isNotNull(), at)).over(each))
    both = both.where(F.col("batch").isNotNull() | F.col("known").isNull() | (at > F.col("known")))
    # What has the place of the row before it is that snapshot again.
    both = both.withColumn("again", F.lag(at).over(w).eqNullSafe(at) & F.lag(F.lit(True)).over(w).isNotNull()).where("NOT again")
    steps = both.withColumns(
        {
            "number": F.coalesce(F.max("number").over(each), F.lit(0)) + F.count(F.when(F.col("batch").isNull(), 1)).over(w), "previous_id": F.lag("snapshot_id").over(w),
            "before": F.coalesce(F.lag("sections").over(w), F.array().cast("array<string>")), "last": F.lead(F.lit(True)).over(w).isNull(),
        }
    )
    changed = F.when(F.col("batch").isNull(), section_changes("before", "sections"))
    return steps.select("url", "fetched_at", "snapshot_id", "number", "sections", "seen_ms", "previous_id", "last", "touched", changed.alias("changes"))


def start_digests(spark: SparkSession, source: str, target: str, checkpoint: str, run_ts: Column, available_now: bool = True, extractor: str | None = None) -> StreamingQuery:
    """Appends the digests of new snapshots to ``target``; each batch is a folder of its own, so a repeated one overwrites itself."""

    def batch(rows: DataFrame, number: int) -> None:
        # Each snapshot is a document of its own here, also where a batch brings several of one URL.
        when = rows.select("snapshot_id", F.col("source_url").alias("of"), "fetched_at").distinct()
        entries = entries_of(rows, extractor).withColumn("output", F.concat_ws("|", "url", "snapshot_id"))
        docs = extract(entries, run_ts).withColumn("real", F.col("url")).withColumn("url", F.col("output"))
        made = digests(docs).withColumn("real", F.expr("substring(url, 1, length(url) - length(snapshot_id) - 1)"))
        made.join(when, (made["snapshot_id"] == when["snapshot_id"]) & (made["real"] == when["of"])).select(
            F.col("real").alias("url"), made["snapshot_id"], "fetched_at", "digest", "sections"
        ).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_states(spark: SparkSession, folder: str, number: int, forgotten_ms: int | None = None) -> DataFrame:
    """The states before a batch, with the ``batch`` that wrote each; of a URL the newest one counts."""
    full = (number - 1) // FULL * FULL
    if not number:
        return spark.createDataFrame([], f"{STATE}, batch long")
    parts = [spark.read.parquet(f"{folder}/batch={n}").where("last").withColumn("batch", F.lit(n).cast("long")) for n in range(full, number)]
    rows = reduce(DataFrame.unionByName, parts).select(*[f.split()[0] for f in STATE.split(", ")], "batch")
    return rows if forgotten_ms is None else rows.where(F.col("seen_ms") > forgotten_ms)


def start_changes(spark: SparkSession, digested: str, target: str, checkpoint: str, forget_ms: int | None = None, files_a_batch: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Appends the changes of new digests to ``target``; each batch is a folder of its own, there and among the states, so a repeated one overwrites itself.

    ``forget_ms`` needs a query that goes on (``available_now=False``).
    """
    if forget_ms and available_now:
        raise ValueError("states are forgotten by a running query only")
    states = f"{checkpoint}/states"

    def batch(rows: DataFrame, number: int) -> None:
        session, now = rows.sparkSession, int(time.time() * 1000)
        made = stepped(rows, read_states(session, states, number, now - forget_ms if forget_ms else None), now)
        kept = made if number % FULL == 0 else made.where("touched")
        kept.write.mode("overwrite").parquet(f"{states}/batch={number}")
        found = session.read.schema(kept.schema).parquet(f"{states}/batch={number}")
        found.select("url", "number", "snapshot_id", "previous_id", F.explode("changes").alias("c")).select("url", "number", "snapshot_id", "previous_id", "c.*").write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(DIGESTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).parquet(digested)
    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def applied(changed: DataFrame) -> DataFrame:
    """``url``, ``section_id`` and ``hash`` of the sections that the changes of a table lead to."""
    last = changed.groupBy("url", "section_id").agg(F.max_by(F.struct("kind", "hash"), "number").alias("c"))
    return last.where("c.kind <> 'removed'").select("url", "section_id", "c.hash")
