"""Snapshots as a store that is added to in place: the work of an upsert follows the URLs that changed.

Below its path the store has three tables:

``contents``   each content once, by its SHA-256, a folder for each two leading digits
``history``    a row a snapshot, without its bytes, a folder a bucket of URLs; only added to
``latest``     the last row of each URL, a folder a bucket; changed buckets are written anew

``upsert`` may be run again after a failure: contents and snapshots that are
there aren't added twice, and ``latest`` follows from both.  One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import normalize_url
from folio.sources.snapshots import SCHEMA, snapshot_index

BUCKETS = 64
META = SCHEMA.removesuffix(", content binary")
_NAMES = [field.split()[0] for field in META.split(", ")]
_TABLES = {"contents": "sha256 string, content binary, shard string", "history": f"{META}, bucket int", "latest": f"{META}, bucket int"}


def bucket_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the store; an empty one before the first upsert."""
    try:
        return spark.read.schema(_TABLES[name]).parquet(f"{path}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _TABLES[name])


def _values(rows: DataFrame, column: str) -> list:
    """The distinct values of a partition column: no more than there are folders."""
    return [r[column] for r in rows.select(column).distinct().collect()]


def upsert(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Adds snapshot rows (as :func:`folio.sources.snapshots.snapshot_rows` makes them) to the store.

    The rows are written down first, so that what was fetched for them is fetched
    once.  Of contents only the folders that may hold the new ones are read, of
    URLs only the buckets of the new ones; all other folders stay as they are.
    """
    rows.select(*_NAMES, "content").write.mode("overwrite").parquet(f"{path}/incoming")
    new = spark.read.schema(SCHEMA).parquet(f"{path}/incoming").withColumns({"bucket": bucket_of(F.col("source_url")), "shard": F.substring("sha256", 1, 2)})
    buckets, shards = _values(new, "bucket"), _values(new, "shard")
    if not buckets:
        return

    have = stored(spark, path, "contents").where(F.col("shard").isin(shards)).select("shard", "sha256")
    fresh = new.select("shard", "sha256").distinct().join(have, ["shard", "sha256"], "left_anti")
    # Equal contents meet as one row a task before they are dealt.
    contents = new.join(fresh, ["shard", "sha256"], "left_semi").groupBy("shard", "sha256").agg(F.first("content").alias("content"))
    contents.select("sha256", "content", "shard").write.mode("append").partitionBy("shard").parquet(f"{path}/contents")

    meta = new.select(*_NAMES, "bucket")
    known = stored(spark, path, "history").where(F.col("bucket").isin(buckets)).select("bucket", "snapshot_id")
    added = meta.dropDuplicates(["bucket", "snapshot_id"]).join(known, ["bucket", "snapshot_id"], "left_anti")
    added.select(*_NAMES, "bucket").hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/history")

    old = stored(spark, path, "latest").where(F.col("bucket").isin(buckets)).select(*_NAMES, "bucket")
    last = old.unionByName(meta).groupBy("bucket", "source_url").agg(F.max_by(F.struct(*_NAMES), F.struct("fetched_at", "snapshot_id")).alias("s"))
    last.select("s.*", "bucket").hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/latest")


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """Per URL the latest snapshot and the ids of all, oldest first."""
    return snapshot_index(stored(spark, path, "history"))


def with_latest(manifest: DataFrame, path: str, check: bool = True) -> DataFrame:
    """Manifest entries with bytes and meta of their latest snapshot; an entry without one ends the run.

    Histories aren't read, and of contents only those that an entry needs are joined.
    """
    spark = manifest.sparkSession
    entries = manifest.withColumn("source_url", normalize_url(F.col("url"))).withColumn("bucket", bucket_of(F.col("source_url")))
    last = stored(spark, path, "latest").select("bucket", "source_url", "snapshot_id", "content_type", "charset", "sha256")
    if check:
        missing = entries.join(last, ["bucket", "source_url"], "left_anti").select("url").limit(5).collect()
        if missing:
            raise ValueError(f"no snapshot of {', '.join(r['url'] for r in missing)}")
    rows = entries.join(last, ["bucket", "source_url"]).withColumn("shard", F.substring("sha256", 1, 2))
    return rows.join(stored(spark, path, "contents"), ["shard", "sha256"]).drop("shard", "sha256", "bucket", "source_url")
