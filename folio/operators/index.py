"""The search index over chunks and the substring query on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.chunk import ORDER, chunk_index

PREVIEW = 1000


def index_chunks(chunked: DataFrame) -> DataFrame:
    """Chunk rows with a preview of the text and its normativity.

    Chunks of one path share a file, and the last one written is what it holds:
    previews and normativity come from it, the hash stays each row's own.
    """
    # A window, not a join with an aggregate: the chunks, and the pages behind them, are read once.
    last = F.max(F.struct(*ORDER, F.substring("text", 1, PREVIEW).alias("text_preview"), "normativity")).over(Window.partitionBy("path"))
    listed = chunk_index(chunked, last.alias("last"))
    return listed.select(*listed.columns[:-1], F.coalesce("last.text_preview", F.lit("")).alias("text_preview"), F.col("last.normativity").alias("normativity"))


def index_documents(chunked: DataFrame) -> DataFrame:
    """One row per document: family and URL of its first chunk, of several first ones the least, and all its chunk ids in order."""
    order = F.struct(*ORDER, "url", "family")
    ids = F.array_sort(F.collect_list(F.struct(*ORDER, "chunk_id")))
    return chunked.groupBy("doc_id").agg(
        F.min_by("family", order).alias("family"), F.min_by("url", order).alias("url"), F.min(F.struct(*ORDER)).alias("first"), F.transform(ids, lambda x: x["chunk_id"]).alias("chunks")
    )


def searched_text() -> Column:
    """What a query looks at: heading, URL and preview, joined by blanks."""
    return F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("text_preview", F.lit("")))


def query_index(index: DataFrame, term: str, family: str | None = None) -> DataFrame:
    """Rows whose heading, URL and preview, joined by blanks, hold ``term`` in any case; of one family if given."""
    if not isinstance(term, str):
        raise TypeError("a term is a string")
    if family:
        index = index.where(F.col("family") == family)
    return index.where(F.contains(F.lower(searched_text()), F.lower(F.lit(term))))


def in_order(rows: DataFrame) -> DataFrame:
    """In the order of the index; for showing, as it sorts all rows."""
    return rows.orderBy(*ORDER)
