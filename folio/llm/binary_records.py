"""Token ids as length-delimited binary records with an offset index.

File format, repeated for each record: the payload's length (8 bytes, little
endian), the masked CRC-32C of those 8 bytes, the payload, the masked CRC-32C of
the payload, and a line feed.  The payload holds the document's id (8 bytes)
and its token ids at a fixed width of 2 or 4 bytes.  The trailing line feed
belongs to the frame: it lets Spark's own text writer commit the files, so a
lost executor leaves no half-written ones, on any file system Spark writes to.

A separate Parquet index holds each record's file, offset and length and the
place of its ids in the whole sequence, for reads in any order.
"""

from __future__ import annotations

import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import IS_SPACE, Words, bytes_of, documents, pieces
from folio.llm.crc32c import checksums

MASK_DELTA = 0xA282EAD8
#: Distinct words, and parts of words, whose ids a Python worker keeps.
CACHE, CACHE_PARTS = 150_000, 40_000


#: Files whose tokens are summed in one task to find where each begins in the whole sequence.
FILES = 1_000


def masked(crc: np.ndarray) -> np.ndarray:
    """Checksums rotated by 15 bits plus a constant, so that a checksum of checksums stays sound."""
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)


def _checked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return masked(checksums(data, starts, ends))


def frames(doc_ids: list[int], ids: list[np.ndarray], width: int) -> list[bytes]:
    """The framed records of some documents."""
    payloads = [struct.pack("<q", d) + x.astype(f"<u{width}").tobytes() for d, x in zip(doc_ids, ids, strict=True)]
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    parts = [x for pair in zip(lengths, payloads, strict=True) for x in pair]
    ends = np.cumsum([len(x) for x in parts], dtype=np.int64)
    crc = _checked(np.frombuffer(b"".join(parts), np.uint8), np.append(0, ends[:-1]) if parts else ends, ends).astype("<u4").tobytes()
    return [b"".join((lengths[i], crc[8 * i : 8 * i + 4], payloads[i], crc[8 * i + 4 : 8 * i + 8], b"\n")) for i in range(len(payloads))]


def unframe(data, offsets: list[int] | None, width: int) -> list[tuple[int, np.ndarray, int, int]]:
    """For the records at ``offsets`` (all records of ``data`` if None): document id, ids, offset and the offset behind it.

    Raises ValueError on damage.
    """
    flat, found, at = np.frombuffer(data, np.uint8), [], 0
    places = iter(offsets) if offsets is not None else None
    while True:
        at = next(places, None) if places is not None else at if at < len(flat) else None
        if at is None:
            break
        if len(flat) < at + 12:
            raise ValueError(f"damaged length at byte {at}")
        stop = at + 12 + int.from_bytes(flat[at : at + 8].tobytes(), "little")
        if stop + 5 > len(flat) or stop < at + 20 or flat[stop + 4] != 10:
            raise ValueError(f"damaged record at byte {at}")
        found.append((at, stop))
        at = stop + 5
    if not found:
        return []
    start, stop = np.array(found, np.int64).T
    for begin, end, what in ((start, start + 8, "length"), (start + 12, stop, "record")):
        said = flat[(end[:, None] + np.arange(4)).ravel()].view("<u4")
        wrong = np.flatnonzero(_checked(flat, begin, end) != said)
        if len(wrong):
            raise ValueError(f"damaged {what} at byte {start[wrong[0]]}")
    return [(int.from_bytes(flat[a + 12 : a + 20].tobytes(), "little", signed=True), np.frombuffer(flat[a + 20 : b].tobytes(), f"<u{width}"), a, b + 5) for a, b in found]


#: The stages of a tokenizer that lower-cases, drops white space and never looks across it.
BY_WORD = (
    'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])',
    'Sequence(pretokenizers=[Split(pattern=Regex("\'s|\'t|\'re|\'ve|\'m|\'ll|\'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"), '
    "behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])",
)
#: Words that such a tokenizer normalises by lower case alone, and their pre-tokens once in lower case.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Coder:
    """A tokenizers file with what a Python worker remembers of it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.core = Tokenizer.from_file(path)
        self.core.encode_special_tokens = True
        self.by_word = (repr(self.core.normalizer), repr(self.core.pre_tokenizer)) == BY_WORD
        self.model = self.core.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {i: level.pre_tokenize_str(chr(i))[0][0] for i in (*range(0x21, 0x7F), *range(0xC0, 0x100))}
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, list[int]] = {}

    def part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            ids = [x.id for x in self.model.tokenize(part if part.isascii() else part.translate(self.bytes))]
            if len(self.parts) < CACHE_PARTS:
                self.parts[part] = ids
        return ids

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of single words as 32-bit integers: the BPE model at once for plain words, all stages for the rest."""
        out: list = [None] * len(words)
        odd = []
        plain, parts, known = PLAIN.fullmatch, PLAIN_PARTS.findall, self.part
        for i, word in enumerate(words):
            if plain(word):
                found = parts(word.lower())
                ids = known(found[0]) if len(found) == 1 else [x for part in found for x in known(part)]
                out[i] = array("I", ids).tobytes()
            else:
                odd.append(i)
        if odd:
            for i, x in zip(odd, self.core.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True):
                out[i] = array("I", x.ids).tobytes()
        return out


coder = lru_cache(2)(Coder)


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the same bytes as the span whose number ``other`` has in its place."""
    size = ends - starts
    if (size != size[other]).any():
        return False
    # Eight bytes of each span at a time, read at any place.
    padded = np.append(data, np.zeros(8, np.uint8))
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at = np.arange(len(size))
    for k in range(0, 64, 8):
        mask = _MASKS[np.minimum(size[at] - k, 8)]
        if ((words[starts[at] + k] ^ words[starts[other[at]] + k]) & mask).any():
            return False
        at = at[size[at] > k + 8]
        if not len(at):
            return True
    return all((data[starts[i] : ends[i]] == data[starts[j] : ends[j]]).all() for i, j in zip(at.tolist(), other[at].tolist(), strict=True) if i != j)


def text_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, and where each text's begin and the last ones end.

    A tokenizer that works by the word encodes each distinct word of a batch
    once, and common words once in a worker's life; any other encodes the texts.
    """
    code = coder(path)
    if not code.by_word:
        texts = [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:], strict=False)]
        ids = [np.array(x.ids, np.uint32) for x in code.core.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    words = Words(data, offsets, IS_SPACE)
    _, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    if not _same(data, words.starts, words.ends, first[inverse]):
        # Two words of one hash: nothing is told apart by hashes then.
        spelt = [bytes(data[a:b]) for a, b in zip(words.starts, words.ends, strict=True)]
        _, first, inverse = np.unique(np.array(spelt, object), return_index=True, return_inverse=True)
    raw = data.tobytes()
    keys = [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
    ids = list(map(code.words.get, keys))
    new = [i for i, x in enumerate(ids) if x is None]
    often = np.bincount(inverse, minlength=len(keys)).tolist()
    for i, x in zip(new, code.encode_words([keys[i].decode() for i in new]), strict=True):
        ids[i] = x
        if often[i] > 1 and len(code.words) < CACHE:
            code.words[keys[i]] = x
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), np.uint32)
    begin = np.cumsum(size) - size
    n = size[inverse]
    place = np.repeat(begin[inverse] - (np.cumsum(n) - n), n)
    place += np.arange(len(place))
    return flat[place], np.concatenate([[0], np.cumsum(n)])[words.first]


def _frames(path: str, end_id: int, width: int):
    def run(batches):
        for batch in pieces(batches, 2048, 3 << 20):
            ids, stops = text_ids(*bytes_of(batch.column(1)), path)
            made = frames(batch.column(0).to_pylist(), [np.append(ids[a:b], np.uint32(end_id)) for a, b in zip(stops, stops[1:], strict=False)], width)
            yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in made], pa.binary())], ["frame"])

    return run


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, vocabulary: int, partitions: int) -> None:
    """Encodes ``documents`` and writes them in ascending order of ``doc_id`` (then text) to ``folder``.

    The numbers in the files' names ascend as their records do.  A null or empty
    text is one end id; repeated rows are written each, ties of an id in order of
    their texts; a null ``doc_id`` counts as the smallest long; an empty table
    gives no records; other columns are dropped, whatever their names.
    ``partitions`` bounds the files' sizes; one record, of a text of any length,
    is never split.
    """
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    docs = documents(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    ordered = docs.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    # The writer adds the line feed that ends a frame.
    ordered.mapInArrow(_frames(tokenizer_path, end_id, width), "frame binary").select(F.expr("cast(frame as string)").alias("value")).write.text(f"{folder}/records")
    _index(docs.sparkSession, folder, width).write.parquet(f"{folder}/index")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/records").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _scan(width: int):
    def run(frames):
        for pdf in frames:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                place, rows = 0, []
                for doc_id, ids, at, stop in unframe(content, None, width):
                    rows.append((file, doc_id, at, stop - at, place, len(ids)))
                    place += len(ids)
                import pandas as pd

                yield pd.DataFrame(rows, columns=["file", "doc_id", "offset", "length", "place", "n_tokens"])

    return run


def _index(spark: SparkSession, folder: str, width: int) -> DataFrame:
    schema = "file string, doc_id long, offset long, length long, place long, n_tokens long"
    found = _files(spark, folder).mapInPandas(_scan(width), schema)
    return found.withColumn("width", F.lit(width))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index: ``file``, ``doc_id``, ``offset``, ``length``, ``start`` (ids before the record), ``n_tokens``, ``width``.

    ``start`` adds to a record's place in its file the ids of all files before it,
    files in order of the numbers in their names.  One row per file is summed in
    order within blocks of files, then one row per block.
    """
    index = spark.read.parquet(f"{folder}/index")
    number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("long")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("total")).withColumn("number", number).withColumn("block", F.expr(f"number div {FILES}"))
    blocks = files.groupBy("block").agg(F.sum("total").alias("sum"))
    blocks = blocks.select("block", (F.sum("sum").over(Window.orderBy("block")) - F.col("sum")).alias("earlier"))
    inside = F.sum("total").over(Window.partitionBy("block").orderBy("number")) - F.col("total")
    before = files.select("file", "block", inside.alias("inside")).join(blocks, "block").select("file", (F.col("earlier") + F.col("inside")).alias("before"))
    return index.join(before, "file").withColumn("start", F.col("before") + F.col("place")).drop("before", "place", "total")


def map_records(spark: SparkSession, folder: str, function, schema: str, index: DataFrame | None = None) -> DataFrame:
    """What ``function(doc_id, start, ids)`` makes of the records in ``index`` (all of them if None): one row each.

    Records are read at their offsets and their checksums verified; the ids stay in the task.
    """
    index = read_index(spark, folder) if index is None else index
    rows = index.groupBy("file").agg(F.collect_list(F.struct("offset", "start", "width")).alias("rows"))

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for content, places in zip(pdf["content"], pdf["rows"], strict=True):
                # All records of an index have one width.
                found = unframe(content, [r["offset"] for r in places], places[0]["width"])
                yield pd.DataFrame([function(doc_id, r["start"], ids) for r, (doc_id, ids, _, _) in zip(places, found, strict=True)], columns=names)

    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return _files(spark, folder).join(rows, "file").select("content", "rows").mapInPandas(run, schema)


def read_records(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``start``, ``ids`` of the records in ``index``, all of them if None."""
    return map_records(spark, folder, lambda doc_id, start, ids: (doc_id, start, ids.astype(np.int32)), "doc_id long, start long, ids array<int>", index)
