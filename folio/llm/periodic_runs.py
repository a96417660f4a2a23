"""Periodic runs of words: every lag is compared, true stretches are run-length coded.

A text with period q over a stretch equals itself shifted by q there.  So the
word numbers of a document are compared with themselves at every lag up to
``n / min_exponent``, and a stretch of equal places that is long enough is a run.

Comparing is done for whole blocks of lags at once.  A stretch that can make a
run at lag q is at least q long, so that places ``q - 3`` apart meet it; only
there four words are looked at, and n / q places for each q make n log n in all.
Lags at which such a place agrees are then compared in full, unless a shorter
run implies the agreement.  Nothing is missed: every screen is a necessary
condition, and equality is that of the words' bytes.

Documents beyond ``range_bytes`` are dealt over the machines as (document, range
of lags), and the runs of their ranges are gathered by document.

Null texts have no words; null ids, repeated rows and empty tables are like any
others, and columns but ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import Words, bytes_of, documents, pieces, windows

GRAM = 4
#: Lags below are compared in full: a stretch would hold too few grams.
SMALL = 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RESULT = f"doc_id bigint, n_words bigint, runs {RUNS}, text string"
#: Shares of the half stretch at which a candidate must agree too.
PROBES = (1.0, 0.77, 0.51, 0.29, 0.13, 0.89, 0.63)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a column, their numbers (equal for equal bytes), and where each text's words begin."""
    data, offsets = bytes_of(texts)
    words = Words(data, offsets, hashed=False)
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(words.starts), pa.py_buffer(ends), pa.py_buffer(data[words.inside]))
    return found, found.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), words.first


@dataclass
class Scan:
    """Texts under one scan, longest first, each followed by a number that nothing equals."""

    ids: list[np.ndarray]
    min_length: int = 12
    min_exponent: int = 2
    runs: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.order = np.argsort([-len(x) for x in self.ids], kind="stable")
        parts, sizes = [], []
        for rank, i in enumerate(self.order):
            parts += [self.ids[i], np.array([-1 - rank], np.int64)]
            sizes.append(len(self.ids[i]))
        self.sizes = np.array(sizes, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.all = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.grams = windows(self.all.astype(np.uint64), GRAM)

    def need(self, q):
        """Equal places that a run of period ``q`` has at least."""
        return np.maximum(self.min_length, self.min_exponent * q) - q

    def lags(self) -> int:
        return int(self.sizes[0]) // self.min_exponent if len(self.sizes) else 0

    def blocks(self) -> list[tuple[int, int]]:
        """All lags in blocks (from, to), small ones alone."""
        out, q = [], 1
        while q <= self.lags():
            to = q + 1 if q < SMALL else q + max(1, q // 4)
            out.append((q, min(to, self.lags() + 1)))
            q = to
        return out

    def run(self, part: int = 0, parts: int = 1) -> dict:
        """(document, start, end) to period, for the part of the blocks of lags; blocks are dealt round, as they cost about the same."""
        for i, (low, high) in enumerate(self.blocks()):
            if low < SMALL:
                if i % parts == part:
                    self.compare(0, int(self.at[self.longer(low)]), low)
                elif parts > 1:  # the shortest periods imply many others, so each part knows them
                    self.compare(0, int(self.at[self.longer(low)]), low)
            elif i % parts == part:
                self.screen(low, high)
        return self.runs

    def longer(self, q: int) -> int:
        """How many texts, from the longest, can hold a run of period ``q``."""
        return int(np.searchsorted(-self.sizes, -np.maximum(self.min_length, self.min_exponent * q), "right"))

    def compare(self, begin: int, end: int, q: int) -> None:
        """All runs of lag ``q`` within places ``begin`` to ``end``."""
        part = self.all[begin:end]
        if len(part) <= q:
            return
        same = np.flatnonzero(part[:-q] == part[q:])
        if not len(same):
            return
        cut = np.flatnonzero(np.diff(same) != 1)
        first, last = same[np.concatenate([[0], cut + 1])], same[np.concatenate([cut, [len(same) - 1]])] + 1
        good = last - first >= self.need(q)
        for a, b in zip(first[good] + begin, last[good] + begin + q, strict=True):
            rank = int(np.searchsorted(self.at, a, "right")) - 1
            name = (int(self.order[rank]), int(a - self.at[rank]), int(b - self.at[rank]))
            self.runs[name] = min(q, self.runs.get(name, q))

    def screen(self, low: int, high: int) -> None:
        """Lags from ``low`` below ``high``: candidates by grams, then whole comparisons."""
        texts = self.longer(low)
        end = int(self.at[texts])
        n = end - low - GRAM + 1
        if n <= 0:
            return
        place = np.arange(0, n, int(self.need(low)) - GRAM + 1)
        grams = np.concatenate([self.grams[: end - GRAM + 1], np.zeros(high, np.uint64)])
        r, c = np.nonzero(sliding_window_view(grams, high - low)[place + low] == grams[place][:, None])
        i, q = place[r], low + c
        inside = i + q < end - GRAM + 1
        i, q = self.unknown(i[inside], q[inside], low)
        half = (self.need(q) - GRAM + 1) // 2
        right, left = np.ones(len(i), bool), np.ones(len(i), bool)
        for share in PROBES:
            step = np.round(half * share).astype(np.int64)
            right &= (i + q + step < end - GRAM + 1) & (grams[np.minimum(i + step, end - 1)] == grams[np.minimum(i + q + step, end - 1)])
            left &= (i >= step) & (grams[np.maximum(i - step, 0)] == grams[np.maximum(i + q - step, 0)])
        i, q = i[right | left], q[right | left]
        rank = np.searchsorted(self.at, i, "right") - 1
        for key in np.unique(rank * np.int64(high) + q):
            at, lag = divmod(int(key), high)
            self.compare(int(self.at[at]), int(self.at[at + 1]), lag)

    def unknown(self, i: np.ndarray, q: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Without those whose both places lie in one run found before whose period divides the lag: its own stretch is all they can be in."""
        good = np.ones(len(i), bool)
        where = {int(d): int(self.at[rank]) for rank, d in enumerate(self.order)}
        for (d, start, end), period in self.runs.items():
            if end - start > low:
                a, b = np.searchsorted(i, [where[d] + start, where[d] + end])
                good[a:b] &= ~((i[a:b] + q[a:b] < where[d] + end) & (q[a:b] % period == 0))
        return i[good], q[good]


def runs_of(ids: list[np.ndarray], min_length: int = 12, min_exponent: int = 2, part: int = 0, parts: int = 1) -> list[list[tuple[int, int, int]]]:
    """For each list of word numbers its runs (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    for (d, start, end), period in Scan(ids, min_length, min_exponent).run(part, parts).items():
        out[d].append((start, end - start, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def without(words: pa.Array, first: np.ndarray, runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    """The texts, words joined by blanks, without what repeats the first period of a run."""
    n = int(first[-1])
    change = np.zeros(n + 1, np.int64)
    for begin, found in zip(first, runs, strict=False):
        for start, length, period in found:
            change[begin + start + period] += 1
            change[begin + start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change)[:n] == 0)
    lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(kept, first).astype(np.int64)), words.take(pa.array(kept)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def _rows(ids: pa.Array, first: np.ndarray, runs: list, words: pa.Array) -> pa.RecordBatch:
    flat = [r for found in runs for r in found]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(ends), struct)
    text = without(words, first, runs).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first).astype(np.int64)), lists, text], ["doc_id", "n_words", "runs", "text"])


def periodic_runs(docs: DataFrame, min_length: int = 12, min_exponent: int = 2, range_bytes: int = 1 << 16, ranges: int = 16) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``text`` without what runs repeat.

    A run is a stretch of at least ``min_length`` words and ``min_exponent``
    times its smallest period that no neighbouring word extends.  Of its words
    only the first period's stay.  Texts of more than ``range_bytes`` are scanned
    in one task for each such many bytes, ``ranges`` at most: an upper bound of
    the copies of a text, not of the lags, which are dealt over them all.
    """
    docs = documents(docs)
    size = F.octet_length("text")

    def whole(batches):
        for batch in pieces(batches):
            words, ids, first = tokens(batch.column(1))
            yield _rows(batch.column(0), first, runs_of(np.split(ids, first[1:-1]), min_length, min_exponent), words)

    def ranged(batches):
        for batch in pieces(batches, 1):
            _, ids, _ = tokens(batch.column(1))
            part, parts = batch.column(2)[0].as_py(), batch.column(3)[0].as_py()
            found = runs_of([ids], min_length, min_exponent, part, parts)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[0].as_py()] * len(found), pa.string()), *[pa.array([r[k] for r in found], pa.int64()) for k in range(3)]], ["key", "start", "length", "period"]
            )

    def collapsed(batches):
        for batch in pieces(batches):
            words, _, first = tokens(batch.column(1))
            runs = [[(r["start"], r["length"], r["period"]) for r in x or ()] for x in batch.column(2).to_pylist()]
            yield _rows(batch.column(0), first, runs, words)

    short = docs.where(size <= range_bytes).mapInArrow(whole, RESULT)
    # Equal rows have one key and equal runs.
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.col("text")), 256)
    long = docs.where(size > range_bytes).withColumn("key", key)
    parts = F.least(F.ceil(size / F.lit(range_bytes)), F.lit(ranges)).cast("int")
    dealt = long.select("key", "text", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), parts.alias("parts")).repartition("key", "part")
    found = dealt.mapInArrow(ranged, "key string, start bigint, length bigint, period bigint")
    # A run of lag q that a shorter period explains too covers the same words.
    least = found.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    order = F.struct("start", "period", "length")
    gathered = least.groupBy("key").agg(F.sort_array(F.collect_list(order)).alias("r"))
    runs = F.transform("r", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["period"].alias("period")))
    joined = long.join(gathered, "key", "left").select("doc_id", "text", F.coalesce(runs, F.lit(None).cast(RUNS)).alias("runs"))
    return short.unionByName(joined.mapInArrow(collapsed, RESULT))
