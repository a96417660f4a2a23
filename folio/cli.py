"""Commands: snapshot, manual-ingest, extract, chunk, index, query, diff, pipeline."""

from __future__ import annotations

import argparse
import json
import sys
import textwrap
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.families import FAMILIES, families_of
from folio.operators.chunk import chunks
from folio.operators.diff import diff_documents
from folio.operators.extract import extract
from folio.operators.index import in_order, index_chunks, index_documents
from folio.operators.postings import search_index, write_index
from folio.plans import pipeline
from folio.sources import chunk_store, snapshot_store
from folio.sources import snapshots as snap
from folio.sources.documents import chunk_json, index_json, read_documents, write_documents, write_files
from folio.sources.manifest import load_ingest_map, load_manifest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folio", description=__doc__)
    commands = p.add_subparsers(dest="command")

    def command(name: str, *options: tuple[str, object]) -> None:
        c = commands.add_parser(name)
        for option, default in options:
            if default is False:
                c.add_argument(f"--{option}", action="store_true")
            else:
                c.add_argument(f"--{option}", required=default is ..., default=None if default is ... else default, type=type(default) if isinstance(default, int) else str)

    store = ("store", False)
    fetched = (("manifest", "manifest.json"), ("reuse", False), ("timeout", 60_000), store)
    command("snapshot", *fetched, ("out", "snapshots"))
    command("manual-ingest", ("map", ...), ("snapshots", "snapshots"), ("reuse", False), ("refresh", False), store)
    command("extract", ("manifest", "manifest.json"), ("snapshots", "snapshots"), ("out", "specs"), ("format", "parquet"), ("families", None), store)
    command("chunk", ("input", "specs"), ("out", "chunks"), ("format", "parquet"), ("files", False), ("update", False))
    command("index", ("chunks", "chunks"), ("out", None), ("json", None))
    command("query", ("term", ...), ("index", "chunks-index"), ("family", None), ("format", "lines"))
    command("diff", ("from", ...), ("to", ...), ("out", "diffs"), ("format", "parquet"), ("files", False))
    command("pipeline", *fetched, ("snapshots", "snapshots"), ("out", "out"), ("specs", None), ("chunks", None), ("format", "parquet"))
    return p


def stored(spark: SparkSession, path: str, store: bool) -> DataFrame | None:
    """The snapshots so far, None before the first; of a store the latest of each URL, without bytes."""
    if store:
        return snapshot_store.stored(spark, path, "latest")
    try:
        return spark.read.schema(snap.SCHEMA).parquet(path)
    except AnalysisException:
        return None


def keep(rows: DataFrame, path: str, store: bool) -> None:
    """Adds snapshots to the store, or to a plain table."""
    if store:
        snapshot_store.upsert(rows.sparkSession, path, rows)
    else:
        rows.write.mode("append").parquet(path)


def take_snapshots(spark: SparkSession, manifest: DataFrame, path: str, reuse: bool, timeout: int, now, store: bool) -> None:
    urls = snap.to_fetch(manifest, stored(spark, path, store), reuse)
    keep(snap.snapshot_rows(snap.fetch(urls, timeout_ms=timeout), now), path, store)


def with_snapshots(manifest: DataFrame, path: str, store: bool) -> DataFrame:
    return snapshot_store.with_latest(manifest, path) if store else snap.with_snapshots(manifest, manifest.sparkSession.read.parquet(path))


def contract_diff() -> list:
    """The columns of a diff under the contract's names."""
    names = {"from_snapshot": "fromSnapshot", "to_snapshot": "toSnapshot", "changed_at": "changedAt"}
    return [F.col(c).alias(names.get(c, c)) for c in ("url", "from_snapshot", "to_snapshot", "changed_at", "summary", "added", "removed", "changed")]


def make_index(made: DataFrame, out: str) -> None:
    """Rows, lists of trigrams and documents below ``out``."""
    write_index(index_chunks(made), out)
    index_documents(made).write.mode("overwrite").parquet(f"{out}/documents")


def show(rows, as_array: bool) -> None:
    """JSON rows a line, or as one indented array."""
    if not as_array:
        for row in rows:
            print(row)
        return
    at = None
    for at, row in enumerate(rows):
        print("[" if at == 0 else ",")
        print(textwrap.indent(json.dumps(json.loads(row), indent=2, ensure_ascii=False), "  "), end="")
    print("[]" if at is None else "\n]")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    p = parser()
    if not args:
        p.print_help()
        return 0
    try:
        o = vars(p.parse_args(args))
    except SystemExit as end:
        return 1 if end.code else 0
    spark = spark or SparkSession.builder.appName("folio").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp")
    match o["command"]:
        case "snapshot":
            take_snapshots(spark, load_manifest(spark, o["manifest"]), o["out"], o["reuse"], o["timeout"], now, o["store"])
        case "manual-ingest":
            files = snap.read_files(spark, load_ingest_map(spark, o["map"]))
            keep(snap.manual_ingest(files, stored(spark, o["snapshots"], o["store"]), now, o["reuse"], o["refresh"]), o["snapshots"], o["store"])
        case "extract":
            entries = with_snapshots(load_manifest(spark, o["manifest"]), o["snapshots"], o["store"])
            families = families_of([row.asDict(True) for row in spark.read.option("multiLine", True).json(o["families"]).collect()]) if o["families"] else FAMILIES
            write_documents(extract(entries, now, families=families), o["out"], o["format"])
        case "chunk" if o["update"]:
            done = chunk_store.update(spark, o["input"], o["out"], o["format"])
            print(json.dumps(dict(zip(("read", "gone"), done.counts(), strict=True))))
        case "chunk":
            made = chunks(read_documents(spark, o["input"], o["format"]))
            if o["files"]:
                write_files(chunk_json(made, o["out"]), indent=True)
            else:
                made.write.mode("overwrite").partitionBy("family").parquet(o["out"])
        case "index":
            made = spark.read.parquet(o["chunks"])
            # Beside the chunks, which are overwritten as a whole and read as a whole.
            make_index(made, o["out"] or f"{o['chunks'].rstrip('/')}-index")
            if o["json"]:
                index_json(index_chunks(made)).write.mode("overwrite").text(o["json"])
        case "query":
            found = search_index(spark, o["index"], o["term"], o["family"])
            rows = in_order(found)
            show((r["json"] for r in index_json(rows).toLocalIterator()) if o["format"] == "json" else rows.toJSON().toLocalIterator(), o["format"] == "json")
        case "diff":
            made = diff_documents(read_documents(spark, o["from"], o["format"]), read_documents(spark, o["to"], o["format"]), now)
            if o["files"]:
                write_files(made.select(F.concat(F.lit(f"{o['out']}/"), "path").alias("path"), F.to_json(F.struct(*contract_diff())).alias("text")), indent=True)
            else:
                made.write.mode("overwrite").json(o["out"])
        case "pipeline":
            manifest = load_manifest(spark, o["manifest"])
            take_snapshots(spark, manifest, o["snapshots"], o["reuse"], o["timeout"], now, o["store"])
            if o["specs"] or o["chunks"] or o["format"] != "parquet":
                specs, made = o["specs"] or "specs", o["chunks"] or "chunks"
                write_documents(extract(with_snapshots(manifest, o["snapshots"], o["store"]), now), specs, o["format"])
                chunks(read_documents(spark, specs, o["format"])).write.mode("overwrite").partitionBy("family").parquet(made)
                make_index(spark.read.parquet(made), f"{made.rstrip('/')}-index")
            elif o["store"]:
                pipeline.run_entries(with_snapshots(manifest, o["snapshots"], True), now, o["out"])
            else:
                pipeline.run(manifest, spark.read.parquet(o["snapshots"]), now, o["out"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
