"""Snapshots: what was fetched when, with its bytes, as one append-only table."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.text import charset_of, extension_or_own, falsy, iso, normalize_url

SCHEMA = (
    "snapshot_id string, source_url string, final_url string, content_type string, charset string, bytes long, sha256 string, "
    "fetched_at timestamp, file_name string, manual boolean, manual_source_path string, content binary"
)
OCTETS = "application/octet-stream"
#: What a fetch tells the server: its own name, and (fixed value) the types that it would rather have.
HEADERS = {"User-Agent": "folio/0.1", "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"}


def snapshot_rows(fetched: DataFrame, run_ts: Column, manual: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Snapshot rows of ``url``, ``final_url``, ``content_type``, ``content`` (and ``local_path``), all fetched at ``run_ts``.

    The id is a hash of what was asked for and when, the content hash one of the
    bytes.  Columns named in ``keep`` stay.
    """
    url = normalize_url(F.col("url"))
    path = F.col("local_path") if "local_path" in fetched.columns else F.lit(None).cast("string")
    kind = F.coalesce(falsy(F.col("content_type")), F.lit(OCTETS))
    return fetched.select(
        F.sha2(F.concat(url, F.lit("|"), iso(run_ts)), 256).alias("snapshot_id"), url.alias("source_url"), F.coalesce("final_url", url).alias("final_url"), kind.alias("content_type"),
        charset_of(kind).alias("charset"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), run_ts.alias("fetched_at"),
        F.concat(F.lit("content"), extension_or_own(kind, F.coalesce(path, F.lit("")))).alias("file_name"), F.lit(manual).alias("manual"), path.alias("manual_source_path"), "content", *keep,
    )


def snapshot_index(snapshots: DataFrame) -> DataFrame:
    """Per URL the latest snapshot and the ids of all, oldest first."""
    when = F.struct("fetched_at", "snapshot_id")
    ids = F.array_sort(F.collect_list(F.struct("fetched_at", "snapshot_id")))
    return snapshots.groupBy(F.col("source_url").alias("url")).agg(F.max_by("snapshot_id", when).alias("latest"), F.transform(ids, lambda x: x["snapshot_id"]).alias("history"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot of each URL, without bytes: ``source_url``, ``snapshot_id``, ``sha256``."""
    when = F.struct("fetched_at", "snapshot_id")
    return snapshots.groupBy("source_url").agg(F.max_by("snapshot_id", when).alias("snapshot_id"), F.max_by("sha256", when).alias("sha256"))


def to_fetch(manifest: DataFrame, snapshots: DataFrame | None, reuse: bool = False) -> DataFrame:
    """URLs to fetch, each once; with ``reuse`` only those without a snapshot."""
    wanted = manifest.select(normalize_url(F.col("url")).alias("url")).distinct()
    if not reuse or snapshots is None:
        return wanted
    return wanted.join(snapshots.select(F.col("source_url").alias("url")), "url", "left_anti")


#: Bytes of an answer that a task takes in; a longer one is a failure.
ANSWER_BYTES = 256 << 20


def http_get(url: str, timeout: float) -> tuple[str, str, bytes]:
    """Final URL, content type and bytes; raises on any status but success, and on answers beyond :data:`ANSWER_BYTES`."""
    with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS), timeout=timeout) as answer:
        body = answer.read(ANSWER_BYTES + 1)
        if len(body) > ANSWER_BYTES:
            raise ValueError(f"{url} answers with more than {ANSWER_BYTES} bytes")
        return answer.geturl(), answer.headers.get("Content-Type") or OCTETS, body


def fetch(urls: DataFrame, get: Callable[[str, float], tuple[str, str, bytes]] = http_get, timeout_ms: int = 60_000, quarantine: bool = False) -> DataFrame:
    """Fetches each URL in the tasks.

    The first failure ends the run, when other tasks may have asked for theirs
    already, or, with ``quarantine``, becomes a row with ``error``.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    rows.append((url, *get(url, timeout_ms / 1000), None))
                except Exception as error:
                    if not quarantine:
                        raise
                    rows.append((url, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["url", "final_url", "content_type", "content", "error"])

    return urls.select("url").mapInPandas(run, "url string, final_url string, content_type string, content binary, error string")


def read_files(spark: SparkSession, ingest_map: DataFrame) -> DataFrame:
    """Bytes of the files that an ingest map names; a missing file ends the run.

    The map is a hand-written list, so its paths go through the driver.
    """
    paths = [r["localPath"] for r in ingest_map.select("localPath").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "doc_seq long, url string, local_path string, content_type string, final_url string, content binary")
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("file"), "content")
    named = ingest_map.withColumn("file", F.regexp_replace("localPath", "^([a-z0-9]+:)?/*", "/"))
    return named.join(files, "file").select("doc_seq", F.col("sourceUrl").alias("url"), F.col("localPath").alias("local_path"), F.col("contentType").alias("content_type"), F.lit(None).cast("string").alias("final_url"), "content")


def manual_ingest(files: DataFrame, snapshots: DataFrame | None, run_ts: Column, reuse: bool = False, refresh: bool = False) -> DataFrame:
    """New snapshot rows of local files.

    ``refresh`` leaves out files whose bytes are those of the latest snapshot and
    comes before ``reuse``, which leaves out all URLs that have a snapshot.
    """
    rows = snapshot_rows(files, run_ts, manual=True)
    if snapshots is None or not (reuse or refresh):
        return rows
    known = latest(snapshots)
    return rows.join(known, ["source_url", "sha256"] if refresh else "source_url", "left_anti").select(*rows.columns)


def with_snapshots(manifest: DataFrame, snapshots: DataFrame, check: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Manifest entries with bytes and meta of their latest snapshot; an entry without one ends the run.

    An entry stays one row: of snapshots of one URL and moment that with the
    greatest hash holds.  ``by`` names columns of both that tell apart entries and
    snapshots of one URL.
    """
    key = ["source_url", *by]
    entries = manifest.withColumn("source_url", normalize_url(F.col("url")))
    if check:
        missing = entries.join(snapshots.select(*key), key, "left_anti").select("url").limit(5).collect()
        if missing:
            raise ValueError(f"no snapshot of {', '.join(r['url'] for r in missing)}")
    last = Window.partitionBy(*key).orderBy(F.desc("fetched_at"), F.desc("snapshot_id"), F.desc("sha256"))
    rows = snapshots.withColumn("nth", F.row_number().over(last)).where("nth = 1").select(*key, "snapshot_id", "content_type", "charset", "content")
    return entries.join(rows, key).drop("source_url")
