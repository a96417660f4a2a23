"""Long repeated byte strings by a run-length index over sampled suffixes.

Sampling: of the 32-byte grams in a 400-byte string the least by hash (the first
of equals) is its anchor.  Equal strings have equal anchors at equal places, so
only suffixes that start at anchors are indexed, and only those whose anchor
stands elsewhere too.

Index: Spark sorts the sampled suffixes of a partition, as a suffix array does.
The text before a suffix takes the place of the Burrows-Wheeler transform's
preceding symbol, and neighbours with equal suffix and equal text before collapse
into one run, so of any number of copies one row and its two ends remain.

Matching statistics stream over how many bytes of a string lie before its
anchor, from none to all that can.  At each step the common prefixes of
neighbouring suffixes cut the order into intervals that share the bytes after
the anchor, and those of the reversed texts before it into intervals that share
the bytes before; a string occurs twice where two rows are in the same interval
of both.  All comparisons are of bytes; hashes only choose anchors and partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import bytes_of, mix, pieces, powers
from folio.llm.sharing import PAIR_SCHEMA, dealt, pair_batch, shared_names, slices, with_texts

LENGTH, GRAM = 400, 32
#: Places for the anchor in a string, bytes hashed at a time, and bytes of rows indexed at a time.
PLACES, STEP, INDEX_BYTES = LENGTH - GRAM + 1, 1 << 19, 4 << 20
#: Rows of hot anchors are dealt by this many bytes on the longer side besides the anchor.
HALF = LENGTH // 2


def gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data)
    up, down = powers(n + 1)
    part = data.astype(np.uint64)
    part += np.uint64(1)
    part *= up[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(part, out=total[1:])
    return mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a batch: where they stand, their names, and the first and last string start that has each."""
    found = []
    mask = np.uint64((1 << 20) - 1)
    for at in range(0, max(0, len(data) - LENGTH + 1), STEP):
        part = data[at : at + STEP + LENGTH - 1]
        hashes = gram_hashes(part)
        n = len(hashes) - PLACES + 1
        # The place in the low bits makes the first of equals the least.
        key = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        rows = -(-len(key) // PLACES)
        block = np.full(rows * PLACES, np.uint64(2**64 - 1))
        block[: len(key)] = key
        block = block.reshape(rows, PLACES)
        ahead = np.minimum.accumulate(block, 1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[PLACES - 1 : PLACES - 1 + n]) & mask).astype(np.int64)
        start = np.arange(at, at + n)
        text = np.searchsorted(offsets, start, "right") - 1
        inside = start + LENGTH <= offsets[text + 1]
        start, place, text = start[inside], place[inside], text[inside]
        if len(start):
            new = np.ones(len(start), bool)
            new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            found.append((place[first] + at, hashes[place[first]], start[first], start[np.append(first[1:], len(start)) - 1]))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pairs(batches):
    for batch in pieces(batches):
        doc_ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = bytes_of(batch.column(2))
        place, name, _, _ = anchors(data, offsets)
        if not len(place):
            continue
        text = np.searchsorted(offsets, place, "right") - 1
        order = np.lexsort((place, name, text))
        place, name, text = place[order], name[order], text[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(name)) - 1
        # Neighbouring pieces of a long text may both report one anchor.
        yield pair_batch(name[first], text[first], doc_ids, copies, ties=True, twice=place[last] > place[first])


SPANS = "key long, doc_id long, copy int, place long, low long, high long, full boolean, before binary, after binary"


def _spans(batches):
    for batch in pieces(batches):
        doc_ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = bytes_of(batch.column(2))
        place, name, low, high = anchors(data, offsets)
        text = np.searchsorted(offsets, place, "right") - 1
        cuts = np.searchsorted(text, np.arange(len(doc_ids) + 1))
        raw, rows, seen = data.tobytes(), [], {}
        for i, (own, often) in enumerate(zip(slices(batch.column(3)), slices(batch.column(4)), strict=True)):
            part = slice(cuts[i], cuts[i + 1])
            hot = set(often.view(np.uint64).tolist())
            for j in (np.flatnonzero(np.isin(name[part], own.view(np.uint64))) + cuts[i]).tolist():
                p, a, b, base = int(place[j]), int(low[j]), int(high[j]), int(offsets[i])
                before, after = raw[a:p], raw[p : b + LENGTH]
                twin = seen.get((before, after))
                row = [int(name[j]), i, p - base, a - base, b - base, twin is not None, before, after, int(name[j]) in hot]
                if twin is None:
                    seen[before, after] = row
                else:
                    # Equal to a row of this batch: both are repeats, and one of them stands in the index.
                    twin[5] = True
                    row[6] = row[7] = b""
                rows.append(row)
        out = []
        for n, (key, i, p, a, b, full, before, after, hot) in enumerate(rows):
            if full and not after:
                out.append((key ^ (n * 0x9E3779B97F4A7C15 % 2**64), i, p, a, b, full, before, after))
            elif not hot:
                out.append((key, i, p, a, b, full, before, after))
            else:
                near = max(a, p - HALF)
                if near <= b:
                    out.append((key ^ hash_of(after[:HALF]), i, p, near, b, full, before[len(before) - (p - near) :], after))
                if a < near:
                    out.append((key ^ hash_of(before[-HALF:]) ^ 1, i, p, a, min(b, near - 1), full, before, after))
        if out:
            keys, at, p, a, b, full, before, after = zip(*out, strict=True)
            at = np.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(doc_ids[at]), pa.array(copies[at]), pa.array(p, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(full), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                ["key", "doc_id", "copy", "place", "low", "high", "full", "before", "after"],
            )


def hash_of(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(raw)


def _shared_prefix(rows: list[bytes], keys: np.ndarray, width: int) -> np.ndarray:
    """How many bytes each row of a sorted list shares with the one before; -1 where the key changes."""
    n = len(rows)
    size = np.array([len(x) for x in rows])
    flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(n, width)
    out = np.full(n, -1)
    for at in range(1, n, 2048):
        a, b = flat[at - 1 : min(n, at + 2048) - 1], flat[at : at + 2048]
        same = a == b
        length = np.where(same.all(1), width, np.argmin(same, 1))
        out[at : at + 2048] = np.minimum(length, np.minimum(size[at - 1 : min(n, at + 2048) - 1], size[at : at + 2048]))
    out[1:][keys[1:] != keys[:-1]] = -1
    return out


def repeats(keys: np.ndarray, before: list[bytes], after: list[bytes], least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For rows sorted by (key, after): which strings with k bytes before the anchor occur twice, as a matrix over k.

    Row i has such strings for k from ``least[i]`` to ``most[i]``.
    """
    n = len(keys)
    hit = np.zeros((n, PLACES), bool)
    right = _shared_prefix(after, keys, LENGTH)
    reverse = [x[::-1] for x in before]
    order = np.array(sorted(range(n), key=lambda i: (keys[i], reverse[i])))
    left = _shared_prefix([reverse[i] for i in order], keys[order], PLACES)
    rank = np.empty(n, np.int64)
    for k in range(int(least.min()), int(most.max()) + 1):
        alive = np.flatnonzero((least <= k) & (k <= most))
        if len(alive) < 2:
            continue
        interval = np.cumsum(right < LENGTH - k)
        rank[order] = np.cumsum(left < k)
        both = interval[alive] * (n + 1) + rank[alive]
        by = np.argsort(both, kind="stable")
        same = both[by][1:] == both[by][:-1]
        hit[alive[by[1:][same]], k] = True
        hit[alive[by[:-1][same]], k] = True
    return hit


def _index(rows: list[tuple]):
    """Intervals [start, stop) of repeated bytes of each row: (document, copy, start, stop)."""
    keys, docs, copies, place, low, high, full, before, after = (list(x) for x in zip(*rows, strict=True))
    keys, place, low, high, full = np.array(keys), np.array(place), np.array(low), np.array(high), np.array(full, bool)
    n = len(keys)
    # Runs: neighbours that are equal altogether are repeats of each other; the first stands for the run.
    texted = np.array([bool(x) for x in after])
    equal = np.zeros(n, bool)
    equal[1:] = [texted[i] and keys[i] == keys[i - 1] and after[i] == after[i - 1] and before[i] == before[i - 1] for i in range(1, n)]
    full |= equal
    full[:-1] |= equal[1:]
    ends = np.flatnonzero(texted & ~equal)
    hit = np.zeros((n, PLACES), bool)
    if len(ends) > 1:
        hit[ends] = repeats(keys[ends], [before[i] for i in ends], [after[i] for i in ends], (place - high)[ends], (place - low)[ends])
    out = [(docs[i], copies[i], int(low[i]), int(high[i]) + LENGTH) for i in np.flatnonzero(full)]
    hit[full] = False
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    for (i, a), (_, b) in zip(np.argwhere(edge == 1), np.argwhere(edge == -1), strict=True):
        out.append((docs[i], copies[i], int(place[i] - (b - 1)), int(place[i] - a) + LENGTH))
    return out


#: Rows equal to the one before whose intervals are handed on together.
EQUAL_ROWS = 100_000


def _intervals(batches):
    """Rows come sorted, so equal ones follow each other: only the first of them is kept, however many there are."""

    def done(found):
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "copy", "start", "stop"])

    rows, size, equal = [], 0, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
            if rows and row[8] and row[0] == rows[-1][0] and row[7:] == rows[-1][7:]:
                rows[-1] = (*rows[-1][:6], True, *rows[-1][7:])
                equal.append((row[1], row[2], row[4], row[5] + LENGTH))
                if len(equal) >= EQUAL_ROWS:
                    yield done(equal)
                    equal = []
                continue
            if size >= INDEX_BYTES and row[0] != rows[-1][0]:
                yield done(_index(rows))
                rows, size = [], 0
            rows.append(row)
            size += len(row[7]) + len(row[8]) + 100
    if rows:
        yield done(_index(rows))
    if equal:
        yield done(equal)


def _remove(batches):
    for batch in pieces(batches):
        copies, lists = batch.column(1).to_numpy(), batch.column(3)
        values, offsets = lists.values, lists.offsets.to_numpy()
        start, stop, copy = (values.field(x).to_numpy() for x in ("start", "stop", "copy"))
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for i, raw in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            part = slice(offsets[i], offsets[i + 1])
            mine = copy[part] == copies[i]
            at, removed, spans, out = 0, 0, 0, []
            end = -1
            for a, b in sorted(zip(start[part][mine].tolist(), stop[part][mine].tolist(), strict=True)):
                if a > end:
                    out.append(raw[at:a])
                    spans += 1
                    removed += b - a
                    end = b
                elif b > end:
                    removed += b - end
                    end = b
                at = end
            out.append(raw[at:])
            n_bytes.append(len(raw))
            n_removed.append(removed)
            n_spans.append(spans)
            kept.append(b"".join(out))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_long_repeats(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``, the bytes left.

    A byte goes if it lies in a 400-byte string of its text that also starts
    anywhere else, in the same text or another; all strings are judged on the
    input.  Null texts are empty; every row is a text of its own, rows of one id
    too; a null ``doc_id`` counts as the smallest long; other columns are dropped.
    """
    base = dealt(docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = shared_names(base.mapInArrow(_pairs, PAIR_SCHEMA), ties=True)
    spans = with_texts(base, names).select("doc_id", "copy", "text", "names", "hot").mapInArrow(_spans, SPANS)
    ordered = spans.repartition(n, "key").sortWithinPartitions("key", "after", "before")
    found = ordered.mapInArrow(_intervals, "doc_id long, copy int, start long, stop long")
    lists = found.groupBy("doc_id").agg(F.collect_list(F.struct("copy", "start", "stop")).alias("cuts"))
    none = F.from_json(F.lit("[]"), "array<struct<copy:int,start:long,stop:long>>")
    final = base.join(lists, "doc_id", "left").select("doc_id", "copy", "text", F.coalesce("cuts", none).alias("cuts"))
    return final.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
