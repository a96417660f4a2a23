"""Manifests: JSON arrays of entries, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import falsy

ENTRY = ("url", "family", "authority", "extractor", "output", "label")
INGEST = ("sourceUrl", "localPath", "contentType")


def _array(spark: SparkSession, path: str, names: tuple[str, ...], what: str) -> DataFrame:
    """Rows of a JSON array of objects, with their place; an error if the file is no array."""
    whole = spark.read.text(path, wholetext=True).withColumn("json", F.try_parse_json("value"))
    bad = whole.where("json is null or schema_of_variant(json) not like 'ARRAY%'")
    if not bad.isEmpty():
        raise ValueError(f"{what} must be a JSON array")
    schema = f"array<struct<{','.join(f'{n}:string' for n in names)}>>"
    return whole.select(F.posexplode(F.from_json("value", schema)).alias("doc_seq", "e")).select(F.col("doc_seq").cast("long"), *[falsy(F.col(f"e.{n}")).alias(n) for n in names])


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries with a URL; every other field may be null, and an empty string counts as null."""
    return _array(spark, path, ENTRY, "a manifest").where("url is not null")


def load_ingest_map(spark: SparkSession, path: str) -> DataFrame:
    """Entries that name both a URL and a file."""
    return _array(spark, path, INGEST, "an ingest map").where("sourceUrl is not null and localPath is not null")
