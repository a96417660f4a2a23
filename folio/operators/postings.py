"""The search index as trigram postings: a term reads only the lists and rows that may hold it.

``write_index`` numbers the rows of an index (see :mod:`folio.operators.index`)
and lists, for every three characters that stand in a row's searched text, the
numbers of the rows that hold them.  Lists are cut into segments of rows, so that
none grows with the corpus, and dealt into buckets by their characters, sorted.

``search_index`` takes the rarest trigrams of a term, intersects their lists
segment by segment, and looks for the term itself only in the rows left.  It
returns what :func:`folio.operators.index.query_index` returns for all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.index import query_index, searched_text

#: Buckets of lists, and the bits of a row's number that say where in its segment it stands.
BUCKETS, SEGMENT_BITS = 64, 18
GRAM = 3
#: Characters of rows whose lists are made at a time.
CHARS = 1 << 21


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.crc32(gram), F.lit(BUCKETS)).cast("int")


def grams_of(folded: str) -> list[str]:
    return sorted({folded[i : i + GRAM] for i in range(len(folded) - GRAM + 1)})


def lists_of(texts: list[str], places: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The trigrams of texts in order, the bounds of their lists, and the lists: of each trigram the places of the texts that hold it."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    data, sizes = np.concatenate(points), np.fromiter(map(len, points), np.int64, len(points))
    seen = np.zeros(0x110000, bool)
    seen[data] = True
    alphabet, rank = np.flatnonzero(seen), np.cumsum(seen) - 1
    k, n = len(alphabet), len(texts)
    if k**3 * n >= 1 << 63:  # trigram and text don't fit a number together
        raise OverflowError
    c = rank[data]
    # A trigram starts at each character but the last two of a text.
    starts = np.ones(len(data), bool)
    starts[(np.cumsum(sizes)[:, None] - np.arange(1, GRAM)).ravel()] = False
    at = np.flatnonzero(starts)
    keys = np.sort((((c[at] * k + c[at + 1]) * k + c[at + 2]) * n) + np.repeat(np.arange(n), sizes)[at])
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    gram, text = np.divmod(keys, n)
    bounds = np.append(np.flatnonzero(np.append(True, gram[1:] != gram[:-1])), len(gram))
    g = gram[bounds[:-1]]
    names = np.stack([alphabet[g // k // k], alphabet[g // k % k], alphabet[g % k]], 1).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [names[i : i + GRAM] for i in range(0, len(names), GRAM)], bounds, places[text]


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of the rows of a few batches, by trigram and segment; what moves is a list, not each place."""

    def made(segment: int, texts: list[str], places: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not texts:
            return
        try:
            grams, bounds, found = lists_of(texts, places)
        except OverflowError:
            half = len(texts) // 2
            yield from made(segment, texts[:half], places[:half])
            yield from made(segment, texts[half:], places[half:])
            return
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))
        for i in range(0, len(grams), 1 << 14):
            part = lists[i : i + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(grams[i : i + len(part)], pa.string()), pa.array([segment] * len(part), pa.int64()), part], ["gram", "segment", "places"])

    now, texts, places, size = None, [], [], 0
    for batch in batches:
        for segment, place, folded in zip(*(batch.column(c).to_pylist() for c in ("segment", "place", "folded")), strict=True):
            if texts and (segment != now or size >= CHARS):
                yield from made(now, texts, np.array(places))
                texts, places, size = [], [], 0
            now, text = segment, folded.decode("utf-8", "replace")
            if len(text) >= GRAM:
                texts.append(text)
                places.append(place)
                size += len(text)
    yield from made(now, texts, np.array(places))


def write_index(index: DataFrame, path: str) -> None:
    """Writes ``rows`` (the index, numbered, a folder a segment) and ``grams`` (lists, a folder a bucket) below ``path``.

    The lists are made from the rows as written, so that numbers stay those that
    were stored, whatever is run again.
    """
    spark = index.sparkSession
    numbered = index.withColumn("row", F.monotonically_increasing_id()).withColumn("segment", F.shiftright("row", SEGMENT_BITS))
    numbered.write.mode("overwrite").partitionBy("segment").parquet(f"{path}/rows")
    # A table of folders has no columns while it has no rows; this one, without rows, says what they are.
    numbered.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    place = F.col("row").bitwiseAND((1 << SEGMENT_BITS) - 1).cast("int")
    parts = stored_rows(spark, path).select("segment", place.alias("place"), F.lower(searched_text()).cast("binary").alias("folded")).mapInArrow(listed, "gram string, segment long, places array<int>")
    lists = parts.groupBy("gram", "segment").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    lists = lists.select(bucket_of(F.col("gram")).alias("bucket"), "gram", "segment", F.size("places").alias("n"), "places")
    lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "segment").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def stored_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, segment bigint, n int, places array<int>, bucket int").parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, folded: str, lists: int = 4) -> tuple[DataFrame | None, int]:
    """``segment`` and ``row`` of the rows that hold the ``lists`` rarest trigrams of a folded term, and an upper bound of their number.

    None where a trigram stands in no row.
    """
    grams = grams_of(folded)
    buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})
    postings = stored_lists(spark, path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    # One number a trigram of the term; the lists themselves aren't read for it.
    count = {r["gram"]: r["n"] for r in postings.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    if len(count) < len(grams):
        return None, 0
    rare = sorted(grams, key=lambda g: (count[g], g))[:lists]
    found = postings.where(F.col("gram").isin(rare)).groupBy("segment").agg(F.collect_list("places").alias("l")).where(F.size("l") == len(rare))
    both = F.aggregate(F.slice("l", 2, len(rare)), F.col("l")[0], F.array_intersect)
    rows = found.select("segment", F.explode(both).alias("place"))
    return rows.select("segment", (F.shiftleft("segment", SEGMENT_BITS) + F.col("place")).alias("row")), count[rare[0]]


def search_index(spark: SparkSession, path: str, term: str, family: str | None = None, lists: int = 4, few: int = 10_000) -> DataFrame:
    """Rows of the index at ``path`` that hold ``term`` in any case; of one family if given.

    Terms of one or two characters are in no list and are looked for in all rows.
    Up to ``few`` candidates are broadcast, and only their segments are read; more
    are joined by shuffle.
    """
    if not isinstance(term, str):
        raise TypeError("a term is a string")
    rows = stored_rows(spark, path)
    folded = spark.range(1).select(F.lower(F.lit(term)).alias("t")).first()["t"]
    if len(folded) >= GRAM:
        found, most = candidates(spark, path, folded, lists)
        if found is None:
            return rows.where(F.lit(False)).drop("row", "segment")
        if most <= few:
            segments = [r["segment"] for r in found.select("segment").distinct().collect()]
            rows, found = rows.where(F.col("segment").isin(segments)), F.broadcast(found)
        rows = rows.join(found, ["segment", "row"], "left_semi")
    return query_index(rows, term, family).drop("row", "segment")
