"""Benchmark decontamination by SimHash windows of the items' sizes.

Texts and items are lower-cased words without punctuation; their shingles are
five words.  For each item size, every window of that many words which holds a
shingle of an item of that size gets a SimHash (a window without one has
similarity 0).  Fingerprints are cut into blocks; two within the radius agree in
at least one block up to the radius divided by the number of blocks, so looking
up each block among all such neighbours finds every item within the radius.
Weighted similarity of the shingles themselves (sum of smaller counts over sum
of larger ones) then decides.

The items are a query set: they go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import IS_MARK, LOWER, Words, bytes_of, pieces, windows

SHINGLE, SIMILARITY = 5, 0.8
#: Bits that may differ, and the widths of the blocks.  Similarity 0.8 means 9.7 bits on average, 23 is 4.6 standard deviations more.
RADIUS, BLOCKS = 23, (11, 11, 11, 11, 10, 10)
#: Bounds of one block of items.
ITEMS, ITEM_BYTES = 2_000, 4 << 20

_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprints(shingles: np.ndarray, width: int) -> np.ndarray:
    """The 64-bit SimHash of each run of ``width`` shingles, each weighted by how often it occurs."""
    signs = ((shingles[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.int32) * 2 - 1
    total = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(signs, 0, out=total[1:])
    bits = (total[width:] - total[:-width] > 0).astype(np.uint64)
    return (bits << _SHIFTS).sum(1, dtype=np.uint64)


def block_keys(prints: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for width in BLOCKS:
        out.append((prints >> np.uint64(at)) & np.uint64((1 << width) - 1))
        at += width
    return out


def _neighbours(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)], np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller counts over sum of the larger ones of two bags of shingles."""
    names, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = (np.bincount(i, minlength=len(names)) for i in (inverse[: len(a)], inverse[len(a) :]))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


class Items:
    """One block of items: their fingerprints by size, and the multi-index over them."""

    def __init__(self, items: list[tuple[int, str]]):
        data = [text.lower().encode() for _, text in items]
        words = Words(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64), IS_MARK, LOWER)
        self.ids, self.sizes, self.shingles = [], [], []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for (item, _), a, b in zip(items, words.first, words.first[1:], strict=False):
            if b - a >= SHINGLE:
                self.ids.append(item)
                self.sizes.append(int(b - a))
                self.shingles.append(windows(words.hash[a:b], SHINGLE))
            elif b > a:
                self.short[int(b - a)][int(windows(words.hash[a:b], int(b - a))[0])].append(item)
        sizes = np.array(self.sizes, np.uint64)
        self.prints = np.array([fingerprints(s, len(s))[0] for s in self.shingles], np.uint64)
        self.index = []
        for width, keys in zip(BLOCKS, block_keys(self.prints), strict=True):
            near = _neighbours(width, RADIUS // len(BLOCKS))
            key = ((sizes[:, None] << np.uint64(16)) | (keys[:, None] ^ near)).ravel()
            item = np.repeat(np.arange(len(sizes)), len(near))
            order = np.argsort(key, kind="stable")
            self.index.append((key[order], item[order]))
        sets: dict[int, set[int]] = defaultdict(set)
        for s, size in zip(self.shingles, self.sizes, strict=True):
            for x in s.tolist():
                sets[x].add(size)
        self.known = np.array(sorted(sets), np.uint64)
        self.known_sizes = [sorted(sets[x]) for x in self.known.tolist()]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def anchors(self, shingles: np.ndarray) -> np.ndarray:
        """Where shingles of any item stand."""
        at = np.flatnonzero(self.filter[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
        return at[self.known[place] == shingles[at]]

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (print, item of this size) within the radius."""
        found = []
        for (keys, items), own in zip(self.index, block_keys(prints), strict=True):
            probe = np.uint64(size << 16) | own
            a, b = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
            n = b - a
            if n.any():
                row = np.repeat(np.arange(len(prints)), n)
                found.append(row * len(self.ids) + items[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, item = np.divmod(np.unique(np.concatenate(found)), len(self.ids))
        near = np.bitwise_count(prints[row] ^ self.prints[item]) <= RADIUS
        return row[near], item[near]

    def matches(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Of one text: each item found, with the best similarity, its first window's start and size in words."""
        best: dict[int, tuple[float, int, int]] = {}

        def put(item: int, score: float, start: int, size: int) -> None:
            if item not in best or (score, -start) > (best[item][0], -best[item][1]):
                best[item] = (score, start, size)

        for size, by_hash in self.short.items():
            hashes = windows(words, size)
            for at in np.flatnonzero(np.isin(hashes, np.array(list(by_hash), np.uint64))).tolist():
                for item in by_hash[int(hashes[at])]:
                    put(item, 1.0, at, size)
        shingles = windows(words, SHINGLE)
        at = self.anchors(shingles) if len(self.ids) and len(shingles) else np.zeros(0, np.int64)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, place in zip(at.tolist(), np.searchsorted(self.known, shingles[at]).tolist(), strict=True):
            for size in self.known_sizes[place]:
                low, high = max(0, p - size + SHINGLE), min(p, len(words) - size)
                if low <= high:
                    if spans[size] and spans[size][-1][1] >= low - 1:
                        spans[size][-1] = (spans[size][-1][0], max(high, spans[size][-1][1]))
                    else:
                        spans[size].append((low, high))
        for size, runs in spans.items():
            width = size - SHINGLE + 1
            for low, high in runs:
                prints = fingerprints(shingles[low : high + width], width)
                for row, item in zip(*(x.tolist() for x in self.candidates(size, prints)), strict=True):
                    score = similarity(shingles[low + row : low + row + width], self.shingles[item])
                    if score >= SIMILARITY:
                        put(self.ids[item], score, low + row, size)
        return best


def item_blocks(benchmark: DataFrame, items: int = ITEMS, size: int = ITEM_BYTES):
    """The items in lists of bounded length and size; null ids and texts are left out."""
    block, total = [], 0
    for row in benchmark.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        n = len(row["text"])
        if block and (len(block) >= items or total + n > size):
            yield block
            block, total = [], 0
        block.append((row["item_id"], row["text"]))
        total += n
    if block:
        yield block


def _texts(batch, words_of):
    data, offsets = bytes_of(words_of)
    words = Words(data, offsets, IS_MARK, LOWER)
    return [words.hash[a:b] for a, b in zip(words.first, words.first[1:], strict=False)]


def _matches(block):
    def run(batches):
        items = Items(block)
        for batch in pieces(batches, 512, 1 << 20):
            out = []
            for doc, words in zip(batch.column(0).to_pylist(), _texts(batch, batch.column(1)), strict=True):
                out += [(doc, item, score, start, size) for item, (score, start, size) in sorted(items.matches(words).items())]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return run


def contaminations(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """One row per document and item with a window of similarity 0.8 or more: the best and first such window.

    Null and empty texts and items match nothing; items under five words match
    where all their words stand in a row.  Repeated rows give repeated results, a
    null ``doc_id`` stays null, items without an id are none; an empty table of
    either kind gives an empty result; other columns don't disturb.  Texts of any
    length are searched whole; of windows equally similar the first is told.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    out = None
    for block in item_blocks(benchmark, items):
        part = texts.mapInArrow(_matches(block), "doc_id long, item_id long, similarity double, start_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start_word long, n_words long") if out is None else out


def _clean(block, name: str):
    def run(batches):
        items = Items(block)
        for batch in pieces(batches, 512, 1 << 20):
            keep = [not items.matches(words) for words in _texts(batch, batch.column(batch.schema.get_field_index(name)))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item of ``benchmark`` is found; see :func:`contaminations`."""
    name = "_".join(["folded", *docs.columns])
    out = docs.withColumn(name, F.lower(F.coalesce("text", F.lit(""))))
    for block in item_blocks(benchmark, items):
        out = out.mapInArrow(_clean(block, name), out.schema)
    return out.drop(name)
