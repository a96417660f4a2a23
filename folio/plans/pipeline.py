"""The whole way: manifest and snapshots to documents, chunks and indexes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from folio.operators.chunk import chunks
from folio.operators.extract import extract
from folio.operators.index import index_chunks, index_documents
from folio.sources.snapshots import with_snapshots


@dataclass
class Result:
    documents: DataFrame
    chunks: DataFrame
    index: DataFrame
    index_documents: DataFrame


def run(manifest: DataFrame, snapshots: DataFrame, run_ts: Column, out: str | None = None, rules: dict[str, dict] | None = None) -> Result:
    """Lazy tables of every step; with ``out`` documents and chunks are written there and read back, so each page is parsed once."""
    return run_entries(with_snapshots(manifest, snapshots, check=out is not None), run_ts, out, rules)


def run_entries(entries: DataFrame, run_ts: Column, out: str | None = None, rules: dict[str, dict] | None = None) -> Result:
    """As :func:`run`, of entries that carry their snapshots."""
    spark = entries.sparkSession
    docs = extract(entries, run_ts, rules)
    if out:
        docs.write.mode("overwrite").parquet(f"{out}/documents")
        docs = spark.read.parquet(f"{out}/documents")
    made = chunks(docs)
    if out:
        made.write.mode("overwrite").partitionBy("family").parquet(f"{out}/chunks")
        made = spark.read.parquet(f"{out}/chunks").select(*made.columns)
    index, documents = index_chunks(made), index_documents(made)
    if out:
        index.write.mode("overwrite").partitionBy("family").parquet(f"{out}/index")
        documents.write.mode("overwrite").parquet(f"{out}/index_documents")
        index, documents = spark.read.parquet(f"{out}/index").select(*index.columns), spark.read.parquet(f"{out}/index_documents")
    return Result(docs, made, index, documents)
