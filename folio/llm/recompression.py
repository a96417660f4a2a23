"""Substring dedup by recompression.

Runs of one word, then pairs of neighbouring symbols, are replaced by new
symbols, round by round.  A symbol's name is a digest of what it stands for and
whether it is the left or the right one of a pair is a bit of its name, so all
documents name alike without a dictionary, and equal passages get equal symbols
but for a margin.  Each symbol knows the range of words that settle it: inside
that range nothing outside can change it.

A window is looked up by the longest symbol that it settles, of the last round if
there is one, else of the round before; the least name of equally long ones.
Windows whose symbol no other document has can't be repeats; the others are
verified window by window: the smallest document that has it keeps it.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import Words, bytes_of, mix, pieces, starts_within, windows
from folio.llm.sharing import PAIR_SCHEMA, by_document, dealt_packed, pair_batch, shared_names, slices, unpacked, with_texts

WINDOW = 13
#: Rounds of pairs after the round of runs, at which a window looks for a symbol, one after the other.  A symbol
#: of two rounds is settled by six words at most, so every window of 13 without long runs settles one.
ROUNDS = (3, 2)

_NAME = np.uint64(0x9E3779B97F4A7C15)


def symbols(hashes: np.ndarray, text: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after all rounds, and the words [low, high) that settle each; ``text`` tells whose a word is.

    A symbol's number orders longer ones before shorter ones, then by name.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n))
    name = np.where(length > 1, mix(hashes[at] + length.astype(np.uint64) * _NAME), hashes[at])
    # A run is settled by its words and both neighbours.
    low, high, text = at - 1, at + length + 1, text[at]
    size = np.minimum(length, 15)
    for k in range(rounds):
        right = ((mix(name + np.uint64((k + 1) * 0xD6E8FEB86659FD93 % 2**64)) & np.uint64(1)) == 1)
        joint = text[1:] == text[:-1]
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & joint
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # Alone: a left symbol knows its right neighbour, a right one its left neighbour; at a text's edge nothing can settle it.
        after = np.append(np.where(joint, high[1:], high[:-1] + n), high[-1:] + n) if len(name) else high
        before = np.concatenate([low[:1] - n, np.where(joint, low[:-1], low[1:] - n)])
        pair_name, pair_high = np.append(name[1:], np.uint64(0)), np.append(high[1:], 0)
        next_low = np.where(pair | ~right, low, before)
        next_high = np.where(pair, pair_high, np.where(right, high, after))
        name = np.where(pair, mix(name * _NAME + pair_name + np.uint64(k)), name)
        size = np.where(pair, np.minimum(size + np.append(size[1:], 0), 15), size)
        keep = ~second
        name, low, high, text, size = name[keep], next_low[keep], next_high[keep], text[keep], size[keep]
    return (15 - size).astype(np.uint64) << np.uint64(60) | name >> np.uint64(4), low, high


def _lookup(name: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least name settled within each window, and whether there is one."""
    # Symbols at an edge, which no window settles, must not break the order of the ranges.
    inner = high - low <= width
    name, low, high = name[inner], low[inner], high[inner]
    a, b = np.searchsorted(low, starts, "left"), np.searchsorted(high, starts + width, "right")
    found = b > a
    out = np.zeros(len(starts), np.uint64)
    if found.any():
        size = (b - a)[found]
        power = np.floor(np.log2(size)).astype(np.int64)
        table = [name]
        for k in range(int(power.max())):
            table.append(np.minimum(table[-1][: -(1 << k)], table[-1][1 << k :]))
        best = np.zeros(len(size), np.uint64)
        for k, least in enumerate(table):
            at = np.flatnonzero(power == k)
            best[at] = np.minimum(least[a[found][at]], least[b[found][at] - (1 << k)])
        out[found] = best
    return out, found


def window_names(words: Words, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window of a batch: its first word, its text and the name it is looked up by."""
    counts = words.counts()
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(starts_within(words.first, width, len(words.hash)))
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    name, found = np.zeros(len(starts), np.uint64), np.zeros(len(starts), bool)
    for rounds in ROUNDS:
        rest = np.flatnonzero(~found)
        name[rest], found[rest] = _lookup(*symbols(words.hash, text, rounds), starts[rest], width)
    if not found.all():
        # Windows of little but long runs settle no symbol; their least word stands in.
        least = np.lib.stride_tricks.sliding_window_view(mix(words.hash ^ _NAME), width)[starts[~found]].min(1)
        name[~found] = least
    return starts, text[starts], mix(name)


def _pairs(batches):
    for batch in pieces(unpacked(batches)):
        doc_ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        _, text, name = window_names(Words(*bytes_of(batch.column(2))))
        if len(name):
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
            name, text = name[new], text[new]
            order = np.lexsort((name, text))
            name, text = name[order], text[order]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
            yield pair_batch(name[new], text[new], doc_ids, copies, ties=False)


def _candidates(batches):
    for batch in pieces(unpacked(batches)):
        doc_ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        words = Words(*bytes_of(batch.column(2)))
        starts, text, name = window_names(words)
        cuts = np.searchsorted(text, np.arange(len(doc_ids) + 1))
        maybe = np.zeros(len(starts), bool)
        for i, own in enumerate(slices(batch.column(3))):
            part = slice(cuts[i], cuts[i + 1])
            maybe[part] = np.isin(name[part], own.view(np.uint64))
        starts, text = starts[maybe], text[maybe]
        if len(starts):
            window = windows(words.hash, WINDOW)[starts]
            # Later documents of the batch are settled; the first one's rows still have to meet other batches.
            order = np.lexsort((doc_ids[text], window))
            w, d = window[order], doc_ids[text][order]
            new = np.ones(len(w), bool)
            new[1:] = w[1:] != w[:-1]
            sure = np.zeros(len(w), bool)
            sure[order] = d > d[np.flatnonzero(new)[np.cumsum(new) - 1]]
            key = np.where(sure, mix(window + np.arange(len(window), dtype=np.uint64)), window)
            place = copies[text].astype(np.int64) << 33 | (starts - words.first[text]).astype(np.int64) << 1 | sure
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc_ids[text]), pa.array(place)], ["key", "doc_id", "place"])


def _remove(batches):
    for batch in pieces(unpacked(batches)):
        starts, repeated = slices(batch.column(3)), batch.column(4).to_pylist()
        out, n_words, n_removed = [], [], []
        for i, raw in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            words, removed = raw.split(), 0
            at = starts[i]
            n_words.append(len(words))
            if repeated[i] and len(words) >= WINDOW:
                words, removed = [], len(words)
            elif len(at):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                keep = np.cumsum(edge[:-1]) == 0
                words, removed = list(compress(words, keep)), int(len(words) - keep.sum())
            n_removed.append(removed)
            out.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed`` and ``text``, the kept words between single blanks.

    A word goes if a window of 13 words over it also starts in a document with a
    smaller ``doc_id``; all windows are judged on the input.  Null and empty
    texts have no words; rows of one id don't count as each other's repeats; a
    null ``doc_id`` counts as the smallest long; other columns are dropped.
    """
    base = dealt_packed(docs)
    # A text that a smaller id has in full repeats in every window, and adds nothing to what others repeat.
    once = base.where("not repeated")
    names = shared_names(once.select("doc_id", "copy", "text").mapInArrow(_pairs, PAIR_SCHEMA), ties=False).drop("hot")
    maybe = with_texts(once, names).select("doc_id", "copy", "text", "names").mapInArrow(_candidates, "key long, doc_id long, place long")
    first = F.min("doc_id").over(Window.partitionBy("key"))
    hits = maybe.select(F.col("doc_id").alias("id"), "place", first.alias("first")).where("place % 2 = 1 or id > first").select("id", "place")
    own, start = F.shiftright("place", 33).alias("own"), F.expr("int(shiftright(place, 1) & 4294967295)").alias("start")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = hits.repartition(n, "id").select("id", own, start).groupBy("id", "own").agg(F.collect_list("start").alias("starts"))
    final = with_texts(base, lists, "left").select("doc_id", "copy", "text", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"), "repeated")
    return final.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, text string")
