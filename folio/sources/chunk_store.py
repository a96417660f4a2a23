"""Chunks of a folder of documents, kept up to date: only files that changed are read again.

Below its path the store has ``chunks``, the chunks of every file in folders by a
hash of the file's name, ``ledger``, for each file its size, its time and the
digest of its content, and ``seen``, a folder a run, the files that it looked at
or missed.  A file whose size or time differs is looked at; it is chunked anew only
if its content differs too.  Folders that hold chunks of changed or vanished files
are written anew, all others stay.  The ledger is written last, so that a run that
failed is made up for by the next.

Files of JSON are listed, named and read by the tasks; the driver holds no list.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.chunk import chunks
from folio.sources.documents import listed_files, opened, read_documents, read_listed

BUCKETS = 64
LEDGER = "file string, size long, modified timestamp, digest string"


class Update:
    """The files whose content was chunked, and those that vanished; their names are fetched when asked for."""

    def __init__(self, read: list[str] | DataFrame, gone: list[str] | DataFrame):
        self._read, self._gone = read, gone

    @staticmethod
    def _names(files: list[str] | DataFrame) -> list[str]:
        return files if isinstance(files, list) else sorted(r["file"] for r in files.select("file").collect())

    @property
    def read(self) -> list[str]:
        return self._names(self._read)

    @property
    def gone(self) -> list[str]:
        return self._names(self._gone)

    def counts(self) -> tuple[int, int]:
        """How many were read and how many vanished."""
        return tuple(len(x) if isinstance(x, list) else x.count() for x in (self._read, self._gone))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Update) and (self.read, self.gone) == (other.read, other.gone)


def bucket_of(file: Column) -> Column:
    return F.pmod(F.crc32(file), F.lit(BUCKETS)).cast("int")


def _ledgers(spark: SparkSession, path: str) -> DataFrame:
    """All ledgers written; the last one holds."""
    try:
        return spark.read.schema(f"{LEDGER}, run long").parquet(f"{path}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{LEDGER}, run long")


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks")


def _with_digests(files: DataFrame, source: str) -> DataFrame:
    """``files`` with the ``digest`` of their content, read by the tasks piece by piece."""

    def run(batches):
        store = opened(source)[0]
        for batch in batches:
            found = []
            for file in batch.column("file").to_pylist():
                digest = hashlib.sha256()
                with store.open_input_stream(file) as stream:
                    while piece := stream.read(1 << 20):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield batch.append_column("digest", pa.array(found, pa.string()))

    return files.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in files.dtypes)}, digest string")


def update(spark: SparkSession, source: str, path: str, fmt: str = "json") -> Update:
    """Brings the chunks at ``path`` up to date with the documents in ``source``.

    Of Parquet, whose files hold many documents each, the names of changed files go
    through the driver.
    """
    listed = listed_files(spark, source, {"json": ".json", "parquet": ".parquet"}[fmt])
    ledgers = _ledgers(spark, path)
    run = ledgers.agg(F.max("run")).first()[0] or 0
    known = ledgers.where(F.col("run") == run).select("file", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.col("digest").alias("old_digest"))
    both = listed.join(known, "file", "full")
    other = both.where("old_digest is null or size is null or size <> old_size or modified <> old_modified")
    # Names are few bytes and what they name is many, so they are dealt over a set number of tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = _with_digests(other.where("size is not null").repartition(tasks, "file"), source).unionByName(other.where("size is null").withColumn("digest", F.lit(None).cast("string")))
    kind = F.when(F.col("digest").isNull(), "gone").when(F.col("digest").eqNullSafe(F.col("old_digest")), "touched").otherwise("changed")
    # Written down, so that what follows is about the same files.
    place = f"{path}/seen/run={run + 1}"
    seen.select("file", "size", "modified", "digest", kind.alias("kind"), bucket_of(F.col("file")).alias("bucket")).write.mode("overwrite").parquet(place)
    seen = spark.read.schema(f"{LEDGER}, kind string, bucket int").parquet(place)
    if seen.isEmpty():
        return Update([], [])
    changed, gone, stale = seen.where("kind = 'changed'"), seen.where("kind = 'gone'"), seen.where("kind <> 'touched'")
    # Numbers of folders, of which there are few.
    buckets = [r[0] for r in stale.select("bucket").distinct().collect()]
    if buckets:
        if fmt == "json":
            docs = read_listed(changed.repartition(tasks, "file"), source)
        else:
            scheme = source[: source.index("://") + 3] if "://" in source else ""
            names = [f"{scheme}{r['file']}" for r in changed.select("file").collect()]
            docs = read_documents(spark, names, fmt).withColumn("file", F.regexp_replace("file", "^[a-z0-9]+:/*", "/")) if names else None
        made = None if docs is None else chunks(docs).withColumn("bucket", bucket_of(F.col("file")))
        try:
            kept = stored_chunks(spark, path).where(F.col("bucket").isin(buckets)).join(stale.select("file"), "file", "left_anti")
            made = kept if made is None else made.select(*kept.columns).unionByName(kept)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        if made is not None:
            # A folder that is left without rows is not written by a dynamic overwrite, so rows that say nothing mark each.
            blank = spark.createDataFrame([(b,) for b in buckets], "bucket int").select(*[F.col(c) if c == "bucket" else F.lit(None).cast(t).alias(c) for c, t in made.dtypes])
            made.unionByName(blank).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/chunks")
    rest = ledgers.where(F.col("run") == run).drop("run").join(seen.select("file"), "file", "left_anti")
    rest.unionByName(seen.where("kind <> 'gone'").select("file", "size", "modified", "digest")).withColumn("run", F.lit(run + 1).cast("long")).write.mode("append").parquet(f"{path}/ledger")
    return Update(changed, gone)


def all_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of all files."""
    return stored_chunks(spark, path).where("chunk_id is not null").drop("bucket")
