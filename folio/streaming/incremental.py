"""Chunks of snapshots as they arrive: a file stream into the same operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from folio.operators.chunk import chunks
from folio.operators.extract import extract
from folio.sources.snapshots import SCHEMA


def arriving(spark: SparkSession, path: str, watermark: str = "1 day") -> DataFrame:
    """Snapshots written to a folder, each (URL, content) once within the watermark."""
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    return stream.withWatermark("fetched_at", watermark).dropDuplicatesWithinWatermark(["source_url", "sha256"])


def entries_of(snapshots: DataFrame, extractor: str | None = None) -> DataFrame:
    """Snapshots as entries of a manifest that leaves everything, or all but the extractor, to the families."""
    null = F.lit(None).cast("string")
    return snapshots.select(F.col("source_url").alias("url"), null.alias("family"), null.alias("authority"), F.lit(extractor).cast("string").alias("extractor"), "snapshot_id", "content_type", "charset", "content")


def start(spark: SparkSession, source: str, target: str, checkpoint: str, run_ts: Column, available_now: bool = True, extractor: str | None = None) -> StreamingQuery:
    """Appends the chunks of new snapshots to ``target``; each batch is a folder of its own, so a repeated one overwrites itself."""

    def batch(rows: DataFrame, number: int) -> None:
        chunks(extract(entries_of(rows, extractor), run_ts)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = arriving(spark, source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
