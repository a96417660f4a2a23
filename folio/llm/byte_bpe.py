"""Byte-level BPE over overlapping chunks of long texts.

A long text is cut into chunks that overlap.  Each chunk is pre-tokenised by
itself; a chunk that starts inside a pre-token soon falls into step, and the
first boundary that two neighbours share inside their overlap is where the one
hands over to the other: from equal boundaries on, equal text splits equally.
Neighbours that share none are joined and split again as one.  The pieces
between hand-overs are then encoded independently of each other.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import documents, pieces

#: Characters of a chunk, and by how many it reaches into the next.
CHUNK, OVERLAP = 32_768, 1_024


@lru_cache(4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The BPE of a rank file; built once in each Python worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def token_bytes(ranks_path: str, pattern: str) -> dict[int, bytes]:
    core = encoding(ranks_path, pattern)
    return {rank: token for token, rank in core._mergeable_ranks.items()}


@lru_cache(4)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str, settled: int) -> list[int]:
    """Ends of pre-tokens that hold whatever follows ``text``.

    What lies in the last ``settled`` characters, or in white space that reaches
    into them, may split differently once more text follows.
    """
    stop = len(text) - settled
    while stop > 0 and text[stop - 1].isspace():
        stop -= 1
    out = []
    for match in splitter(pattern).finditer(text):
        if match.end() > stop:
            break
        out.append(match.end())
    return out


def hand_over(own: list[int], text: str, at: int, pattern: str, settled: int = 4) -> int | None:
    """The first boundary after ``at`` that the text from ``at`` on shares with ``own``."""
    ours = set(own)
    return next((at + end for end in boundaries(text[at:], pattern, settled) if at + end in ours), None)


def _chunks(pattern: str, chunk: int, overlap: int):
    """Cuts texts in one pass, and finds where each chunk hands over to the next."""

    def run(batches):
        for batch in pieces(batches):
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                count = max(1, -(-len(text) // chunk))
                parts = [text[i * chunk : (i + 1) * chunk + overlap] for i in range(count)]
                stops = [hand_over(boundaries(x, pattern, 4), x, chunk, pattern) for x in parts[:-1]]
                columns = ([row] * count, range(count), [False] * (count - 1) + [True], parts, [*stops, None])
                types = (pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row", "n", "last", "text", "stop"])

    return run


def stitched(long: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Cuts each text (``row``, ``text``) at pre-token boundaries: ``row``, ``piece``, ``text``."""
    ended = long.select("row", "text").mapInArrow(_chunks(pattern, chunk, overlap), "row string, n int, last boolean, text string, stop long")
    order = Window.partitionBy("row").orderBy("n")
    before = F.lag("stop").over(order)
    part = ended.select(
        "row", "n", "text",
        F.when(before.isNull(), 0).otherwise(before - chunk).alias("a"),
        F.when(F.col("stop").isNotNull(), F.col("stop")).when(F.col("last"), F.length("text")).otherwise(chunk).alias("b"),
        F.sum(F.when(before.isNull(), 0).otherwise(1)).over(order).alias("piece"),
    )
    parts = F.array_sort(F.collect_list(F.struct("n", F.expr("substring(text, int(a) + 1, int(b - a))").alias("text"))))
    return part.groupBy("row", "piece").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def _encoder(ranks_path: str, pattern: str):
    def run(batches):
        core = encoding(ranks_path, pattern)
        for batch in pieces(batches):
            ids = [core.encode_to_numpy(text, disallowed_special=()) for text in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], [*names, "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``ids``: the token ids of each text, one row per input row.

    Texts of up to ``chunk`` characters are encoded where they are read; only
    the chunks of longer ones are shuffled, to meet again; these are known by
    their id and digest, and equal ones are encoded once and returned as often as
    they stand there.  Null and empty texts get no ids, a null ``doc_id`` stays
    null, repeated rows give as many rows, an empty table gives an empty result,
    other columns are dropped, whatever their names.  Texts of any length are
    taken whole, in time linear in it.  ``ranks_path`` must be readable on every
    executor.
    """
    docs, code = documents(docs), _encoder(ranks_path, pattern)
    small = docs.where(F.length("text") <= chunk).mapInArrow(code, "doc_id long, ids array<int>")
    name = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256))
    long = docs.where(F.length("text") > chunk).select(name.alias("row"), "text").groupBy("row").agg(F.first("text").alias("text"))
    # The number of copies is small beside the texts, and joins what is made of them.
    coded = stitched(long, pattern, chunk, overlap).select("row", "piece", "text").mapInArrow(code, "row string, piece long, ids array<int>")
    whole = coded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    counts = docs.where(F.length("text") > chunk).groupBy(name.alias("row"), "doc_id").agg(F.count("*").alias("copies"))
    whole = whole.join(counts, "row").select("doc_id", F.expr("flatten(transform(p, x -> x.ids))").alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return small.unionByName(whole.drop("copy"))


def _decoder(ranks_path: str, pattern: str):
    def run(batches):
        table = token_bytes(ranks_path, pattern)
        for batch in batches:
            lists = batch.column("ids")
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            raw = [b"".join(map(table.__getitem__, values[a:b].tolist())) for a, b in zip(offsets, offsets[1:], strict=False)]
            names = [x for x in batch.schema.names if x != "decoded"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(raw, pa.binary())], [*names, "decoded"])

    return run


def decode(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``: the raw bytes of the tokens in ``ids``, end to end; no ids give no bytes."""
    coded = coded.drop("decoded")
    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return coded.mapInArrow(_decoder(ranks_path, pattern), schema)


def _digests(ranks_path: str, pattern: str):
    decoder = _decoder(ranks_path, pattern)

    def run(batches):
        for batch in decoder(batches):
            lists = batch.column("ids")
            values, offsets = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            ids = [hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(offsets, offsets[1:], strict=False)]
            raw = [hashlib.sha256(x).hexdigest() for x in batch.column("decoded").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(ids), pa.array(raw)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row ``doc_id`` as it is, ``n_tokens`` and SHA-256 in hex of the ids (little-endian, 32 bits) and of the bytes they decode to."""
    return coded.select("doc_id", "ids").mapInArrow(_digests(ranks_path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
