"""Helpers shared by the operators: scratch tables and vectorised words.

Texts reach Python as Arrow batches.  ``Words`` finds and hashes all the words
of a batch with numpy, so no operator loops over single words.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes hashed at a time; keeps the eight-byte temporaries in the cache.
SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine, as in tests, a temporary
    folder is used; on a cluster the setting must be there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: ``df`` as a Parquet table in the shared folder, reread."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``, a null text as an empty one; other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row, and of the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Gives memory that numpy and Arrow have freed back to the machine; workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def pieces(batches, rows: int = 1024, size: int = 2 << 20):
    """Cuts Arrow batches into slices of few rows and, but for single long texts, few bytes of ``text``."""
    for batch in batches:
        at = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(lengths[at : at + rows], dtype=np.int64), size, "right")))
            yield batch.slice(at, n)
            at += n
        trim()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, ``n`` at least."""
    if len(_powers.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(max(n, 2 * SEGMENT), base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the spans ascend and don't overlap.

    ``fold`` maps bytes before they are hashed.  Differences of a running
    polynomial give all spans of a segment at once.
    """
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        part = data[low:high]
        up, down = powers(high - low + 1)
        part = (part if fold is None else fold[part]).astype(np.uint64)
        part += np.uint64(1)
        part *= up[: high - low]
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def _table(separators: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(separators)] = True
    return t


#: Bytes that end a word: white space, or all ASCII but letters and digits.
IS_SPACE = _table(SPACE)
IS_MARK = _table(bytes(i for i in range(128) if not chr(i).isalnum()))
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


class Words:
    """The words of a batch of texts: ``starts``, ``ends``, ``hash`` (where asked for), and ``first[i]:first[i + 1]`` for text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE, fold: np.ndarray | None = None, hashed: bool = True):
        inside = ~separator[data]
        n = len(inside)
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            begin[cuts] = inside[cuts]
            end[cuts - 1] = inside[cuts - 1]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        if hashed:
            self.hash = span_hashes(data, self.starts, self.ends, fold)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive entries."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(_BASE) + hashes[i : i + n]
    return mix(out + np.uint64(width))


def starts_within(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Whether a window of ``width`` that starts at each of ``n - width + 1`` words ends in the same text."""
    size = max(0, n - width + 1)
    good = np.ones(size, bool)
    for back in range(1, width):
        cut = first[1:-1] - back
        good[cut[(cut >= 0) & (cut < size)]] = False
    return good
