"""Which names (of symbols, of anchors) occur in more than one place of a corpus.

Documents are dealt by ``doc_id`` once; every pass over the texts reads that
one shuffle.  Within a batch, rows of one name are settled where they are, and
only one of them stands for all in the shuffle by name, so a name that a third
of all documents hold costs one row a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import mix, pieces, written

#: Hot names that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def dealt(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``copy``, ``text`` dealt by ``doc_id``; ``copy`` numbers the rows of one id, ordered by text.

    Null texts count as empty, null ids as the smallest long; other columns go.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    copy = (F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1).alias("copy")
    return docs.repartition(n, "doc_id").select("doc_id", copy, "text")


def _pack(batches):
    press = zstandard.ZstdCompressor(3)
    for batch in pieces(batches):
        raw = batch.column(1).cast(pa.binary()).to_pylist()
        digests = [hashlib.sha256(x).digest() for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(list(map(press.compress, raw)), pa.binary())], ["doc_id", "digest", "text"])


def unpacked(batches, rows: int = 512):
    """Batches whose packed ``text`` is text again, a few rows at a time."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            texts = pa.array([zstandard.decompress(x) for x in part.column(at).to_pylist()], pa.binary()).cast(pa.string())
            yield part.set_column(at, "text", texts)


def dealt_packed(docs: DataFrame) -> DataFrame:
    """As :func:`dealt`, with the texts compressed, their ``digest``, and ``repeated`` for texts that a smaller ``doc_id`` has in full."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Columns that can't be null: else joins put different filters below the shuffle, and it is made once for each.
    packed = docs.mapInArrow(_pack, "doc_id long, digest binary, text binary")
    packed = packed.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("digest", F.lit(b"")).alias("digest"), "text").repartition(n, "doc_id")
    copy = (F.row_number().over(Window.partitionBy("doc_id").orderBy("digest")) - 1).alias("copy")
    base = packed.select("doc_id", copy, "digest", "text")
    first = base.groupBy("digest").agg(F.min("doc_id").alias("first"))
    later = base.select(F.col("doc_id").alias("id"), F.col("copy").alias("own"), "digest").join(first, "digest").where("id > first")
    later = by_document(later).agg(F.lit(True).alias("repeated"))
    return with_texts(base, later, "left").select("doc_id", "copy", "text", F.coalesce("repeated", F.lit(False)).alias("repeated"))


def settle(names: np.ndarray, docs: np.ndarray, ties: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows (name, document) of a batch: which are known to be shared, and which travel under a key of their own.

    With ``ties`` any two rows share; without, only rows of different documents.
    """
    order = np.lexsort((docs, names))
    n, d = names[order], docs[order]
    new = np.ones(len(n), bool)
    new[1:] = n[1:] != n[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(n)))
    last = first + size - 1
    many = size > 1 if ties else d[last] > d[first]
    known, away = np.zeros(len(n), bool), np.zeros(len(n), bool)
    known[order] = many[group]
    # A name's first row stands for it; where it is known to be shared the rest need not meet it.
    away[order] = many[group] & ~new
    return known, away


PAIR_SCHEMA = "name long, doc_id long, tag long"


def pair_batch(names: np.ndarray, rows: np.ndarray, doc_ids: np.ndarray, copies: np.ndarray, ties: bool, twice: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows (name, document) of a batch, hot names settled.  ``twice`` marks names that a text holds more than once.

    ``tag`` packs the copy, a number that deals rows which need not meet others
    elsewhere, and whether the name is known to be shared.
    """
    known, away = settle(names, doc_ids[rows], ties)
    if twice is not None:
        known |= twice
    lone = np.where(away, (mix(np.arange(len(names), dtype=np.uint64) + mix(names)) | np.uint64(1)) & np.uint64(0xFFFFFFFF), np.uint64(0)).astype(np.int64)
    tag = copies[rows].astype(np.int64) << 33 | lone << 1 | known
    return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(doc_ids[rows]), pa.array(tag)], ["name", "doc_id", "tag"])


def shared_names(pairs: DataFrame, ties: bool, hot: int = 2_000) -> DataFrame:
    """``id``, ``own`` (the copy) and the array ``names``, what the document shares; with ``ties`` also ``hot``, those of them that stand for more batches than that.

    Whether a name is hot is decided by name and holds for all its rows, those that
    travel under a key of their own too.
    """
    over = Window.partitionBy("name", F.col("tag").bitwiseAND(0x1FFFFFFFE))
    n = F.count("*").over(over)
    other = n > 1 if ties else F.min("doc_id").over(over) < F.max("doc_id").over(over)
    found = pairs.select("name", F.col("doc_id").alias("id"), F.shiftright("tag", 33).alias("own"), other.alias("other"), (n > hot).alias("is_hot"), F.col("tag").bitwiseAND(1).alias("known")).where("known = 1 or other")
    if not ties:
        return by_document(found).agg(F.collect_list("name").alias("names"))
    # Only a name's first rows of each batch meet, so they alone see how many batches hold it.
    found = written(found.select("name", "id", "own", "is_hot"), "shared")
    often = found.where("is_hot").groupBy("name").agg(F.lit(True).alias("is_often"))
    if often.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        often = F.broadcast(often)
    found = found.join(often, "name", "left")
    return by_document(found).agg(F.collect_list("name").alias("names"), F.collect_list(F.when(F.col("is_often"), F.col("name"))).alias("hot"))


def by_document(rows: DataFrame):
    """Groups of rows of one ``id`` and ``own``, dealt as :func:`dealt` deals the texts."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").groupBy("id", "own")


def with_texts(base: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """Texts beside what was gathered for them.

    The copy is compared in a way that is no join key, so that the texts, dealt by
    ``doc_id`` alone, are not dealt again.
    """
    return base.join(lists, (F.col("doc_id") == F.col("id")) & (F.col("copy") - F.col("own") == 0), how)


def slices(lists: pa.Array) -> list[np.ndarray]:
    """The entries of each row of a column of arrays of integers."""
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
