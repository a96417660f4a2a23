"""Katz backoff language model over words, trained on one part of the texts and scoring all.

Words are lower-cased and every text ends with one end token; a text's first words
have start symbols for a history.  Counts of n-grams are discounted by Good-Turing
up to a count of five; what a history's followers lose goes to the words it never
had, in proportion to the model of the next lower order, by a weight that makes
each history sum to exactly one:

    P(w | h) = d(r) r / c(h)          where h w was seen r > 0 times
             = a(h) P(w | h')         where not; h' is h without its first word

down to the add-one unigram.  ``order`` is the longest n-gram, 3 unless asked for
otherwise.

Counts live in tables: words by ranges of their hashes, n-grams by their history;
the followers of a history so frequent that it would outgrow a part are dealt over
several parts, and its sums added up again.  Words are numbered by how often they
occur within their part, and n-grams are tuples of these numbers.  A table's rows
are sorted, packed arrays, one for each piece (a batch of texts) and part that has
anything for it, never more than one for each n-gram: a piece asks a part once, for
all its distinct n-grams together, and gets their totals back in the same order.
The number of parts grows with the texts' bytes, so a part doesn't.

A part also says which n-grams one piece alone has, trained or not.  As a history
such an n-gram has all its followers in that piece, which therefore counts them
itself and asks nobody; most n-grams are like that, so most of a long order's
histories never move.  What a piece counted itself joins the totals and tables.
The finished tables are kept as Parquet, partitioned by order, where a folder is
named for them.
"""

from __future__ import annotations

import struct
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import IS_SPACE, LOWER, Words, bytes_of, documents, mix, pieces, scratch, trim

ORDER = 3
#: Counts that Good-Turing discounts.
DISCOUNTED = 5
#: Bytes of text in a piece, and for each part of a table; parts of small inputs are smaller, to keep all cores busy.
PIECE_BYTES, PART_BYTES, LEAST_BYTES = 12 << 20, 4 << 20, 1 << 20
END = np.uint64(0xFEDCBA9876543210)
NO_ID = -(1 << 63)
#: Kinds of rows besides the levels 1, 2, ... of what is asked and answered.
PIECE, TOTALS = 0, -1

ROW = "key long, kind int, pid long, part int, data binary, numbers array<long>"
_NAMES = ("key", "kind", "pid", "part", "data", "numbers")
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
TABLE = "level int, part int, n_entries long, data binary"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, each at the least width, like bytes of all entries together, compressed."""
    out, press = [], zstandard.ZstdCompressor(1)
    for x in arrays:
        top = int(x.max()) if len(x) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        raw = press.compress(np.ascontiguousarray(x.astype(f"u{width}").view(np.uint8).reshape(-1, width).T).tobytes())
        out.append(struct.pack("<BQ", width, len(raw)) + raw)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        width, size = struct.unpack_from("<BQ", data, at)
        at += 9
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + size])
        flat = np.frombuffer(raw, np.uint8).reshape(width, -1)
        out.append(np.ascontiguousarray(flat.T).view(f"u{width}").ravel())
        at += size
    return out


def _ascending(x: np.ndarray) -> np.ndarray:
    """An ascending array as its steps, which pack better."""
    return np.diff(x, prepend=x.dtype.type(0))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], list(_NAMES))


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _rows(table: pa.Table) -> list[tuple]:
    return list(zip(*(table.column(n).to_pylist() for n in _NAMES), strict=True))


def _numbers(order: int, at: int, values: list[int]) -> list[int]:
    """Totals: tokens, types, trained texts, then for each level from 2 how many n-grams were seen 1 to 6 times."""
    out = [0] * (3 + (DISCOUNTED + 1) * (order - 1))
    out[at : at + len(values)] = values
    return out


def cuts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where the ranges of a sorted array of hashes begin and end."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _read(parts: int, order: int):
    """Texts to pieces: their words as numbers, and the counts of their distinct words for the table of words."""

    def run(batches):
        context, number = TaskContext.get(), 0
        for batch in pieces(batches, 1 << 30, PIECE_BYTES):
            pid = (context.partitionId() if context else 0) << 24 | number
            number += 1
            train = batch.column(2).to_numpy(zero_copy_only=False)
            words = Words(*bytes_of(batch.column(1)), IS_SPACE, LOWER)
            n = words.counts()
            # One end behind the words of each text.
            hashes = np.full(len(words.hash) + len(n), END)
            place = np.ones(len(hashes), bool)
            place[np.cumsum(n + 1) - 1] = False
            hashes[place] = words.hash
            del words
            names, ids = np.unique(hashes, return_inverse=True)
            count = np.bincount(ids[np.repeat(train, n + 1)], minlength=len(names))
            # Frequent words get small numbers, which pack better.
            order_, rank = np.argsort(-np.bincount(ids), kind="stable"), np.empty(len(names), np.int64)
            rank[order_] = np.arange(len(names))
            piece = pack(rank, rank[ids], n + 1, batch.column(0).to_numpy().view(np.uint64), train.astype(np.uint8))
            rows = [(-pid - 1, PIECE, pid, 0, piece, None), (0, TOTALS, pid, 0, None, _numbers(order, 2, [int(train.sum())]))]
            for i, (a, b) in enumerate(pairwise(cuts(names, parts))):
                if b > a:
                    rows.append((i, 1, pid, i, pack(_ascending(names[a:b]), count[a:b]), None))
            yield _batch(rows)

    return run


def _grouped(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct tuple of ``columns`` and the number of each row's tuple; ``keys`` are hashes of the tuples."""
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    if all((c == c[first][inverse]).all() for c in columns):
        return first, inverse
    # Two tuples of one hash: by the tuples themselves, then.
    _, first, inverse = np.unique(np.stack(columns, 1), axis=0, return_index=True, return_inverse=True)
    return first, inverse.ravel()


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]), np.uint64(len(columns)))
    for c in columns:
        out = mix(out * _STEP + c.astype(np.uint64))
    return out


def _alone(asked: np.ndarray) -> np.ndarray:
    """Of each entry, by the numbers of the entries that all pieces ask for, whether one piece alone does."""
    return np.bincount(asked) == 1


def _stats(owner: np.ndarray, total: np.ndarray, lower: np.ndarray, histories: int, level: int) -> np.ndarray:
    """For each history: how many followers were seen 1 to 5 times, how often all others, and the same for the totals one level below.

    Of level 2 the last is one row: the sum of the followers' totals, each one more.
    """
    seen = total > 0
    owner, total, lower = owner[seen], total[seen], lower[seen]
    # Filled row by row: of the last level this is the largest array of a piece.
    out, at = np.empty((DISCOUNTED + 2 if level == 2 else 2 * (DISCOUNTED + 1), histories), np.int64), 0
    for count in (total, lower)[: 1 if level == 2 else 2]:
        for k in range(1, DISCOUNTED + 1):
            out[at] = np.bincount(owner[count == k], minlength=histories)
            at += 1
        out[at] = np.bincount(owner[count > DISCOUNTED], count[count > DISCOUNTED], minlength=histories)
        at += 1
    if level == 2:
        out[at] = np.bincount(owner, lower + 1.0, minlength=histories)
    return out


def _entries(columns: list[np.ndarray], owner: np.ndarray, word: np.ndarray, total: np.ndarray) -> tuple[int, bytes]:
    """The n-grams that were seen, as they are kept: how many, and packed by histories."""
    seen = np.flatnonzero(total > 0)
    seen = seen[np.lexsort((word[seen], owner[seen]))]
    n = np.bincount(owner[seen], minlength=len(columns[0]))
    some = np.flatnonzero(n)
    return len(seen), pack(*(c[some] for c in columns), n[some], word[seen], total[seen])


class WordPart:
    """One part of the table of words: the totals of its words and their numbers, the most frequent first."""

    def __init__(self, rows: list[tuple]):
        self.asked = [[np.cumsum(x[0].astype(np.uint64), dtype=np.uint64), x[1]] for x in (unpack(r[4]) for r in rows)]
        self.names, self.inverse = np.unique(np.concatenate([x[0] for x in self.asked]), return_inverse=True)
        self.total = np.bincount(self.inverse, np.concatenate([x[1] for x in self.asked]).astype(float)).astype(np.int64)
        rank = np.empty(len(self.names), np.int64)
        rank[np.argsort(-self.total, kind="stable")] = np.arange(len(self.names))
        self.rank = rank

    def stored(self) -> tuple[int, bytes]:
        return len(self.names), pack(_ascending(self.names), self.rank, self.total)

    def answers(self):
        at, alone = 0, _alone(self.inverse)
        for names, _ in self.asked:
            own = self.inverse[at : at + len(names)]
            at += len(names)
            yield pack(self.rank[own], self.total[own] << 1 | alone[own])


class GramPart:
    """One part of the table of n-grams of one level: what its histories and their followers add up to.

    A row asks for histories (one array of word numbers for each place), each with
    some followers: their numbers, trained counts and totals one level below.
    """

    def __init__(self, rows: list[tuple], level: int):
        asked = [unpack(r[4]) for r in rows]
        for x in asked:
            x[0] = np.cumsum(x[0], dtype=np.int64)
        self.sizes = [(len(x[0]), len(x[level])) for x in asked]
        columns = [np.concatenate([x[i] for x in asked]).astype(np.int64) for i in range(level - 1)]
        followers = np.concatenate([x[level - 1] for x in asked]).astype(np.int64)
        word, trained, lower = (np.concatenate([x[i] for x in asked]).astype(np.int64) for i in (level, level + 1, level + 2))
        self.first_history, self.history = _grouped(_hash(columns), columns)
        of = np.repeat(self.history, followers)
        self.first, self.gram = _grouped(_hash([of, word]), [of, word])
        self.total = np.bincount(self.gram, trained, minlength=len(self.first)).astype(np.int64)
        self.columns, self.word = [c[self.first_history] for c in columns], word[self.first]
        self.owner, self.lower, self.level = of[self.first], lower[self.first], level

    def stored(self) -> tuple[int, bytes]:
        return _entries(self.columns, self.owner, self.word, self.total)

    def stats(self) -> np.ndarray:
        return _stats(self.owner, self.total, self.lower, len(self.columns[0]), self.level)

    def answers(self):
        stats, total, a, b = self.stats(), self.total << 1 | _alone(self.gram), 0, 0
        for histories, grams in self.sizes:
            yield pack(total[self.gram[b : b + grams]], *stats[:, self.history[a : a + histories]])
            a, b = a + histories, b + grams


def _of_level(order: int, level: int, total: np.ndarray) -> list[int]:
    """How many n-grams of a level were seen 1 to 6 times, as totals."""
    return _numbers(order, 3 + (level - 2) * (DISCOUNTED + 1), [int((total == k).sum()) for k in range(1, DISCOUNTED + 2)])


def _counted(level: int, order: int):
    """Totals of one part of a level, for each piece that asked."""

    def run(table: pa.Table) -> pa.Table:
        every = _rows(table)
        # What pieces counted themselves.
        out = [r for r in every if r[1] == TOTALS]
        rows = [r for r in every if r[1] != TOTALS]
        if not rows:
            return _table(out)
        part = WordPart(rows) if level == 1 else GramPart(rows, level)
        out += [(-r[2] - 1, level, r[2], r[3], x, None) for r, x in zip(rows, part.answers(), strict=True)]
        if level == 1:
            numbers = _numbers(order, 0, [int(part.total.sum()), int((part.total > 0).sum())])
        else:
            numbers = _of_level(order, level, part.total)
        out.append((rows[0][0], TOTALS, 0, rows[0][3], None, numbers))
        del part, rows, every
        trim()
        return _table(out)

    return run


def _kept(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("level", "part", "n_entries", "data"), columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)})


def _stored(level: int):
    """One part of a level as a row of the tables that are kept."""

    def run(table: pa.Table) -> pa.Table:
        rows = [r for r in _rows(table) if r[1] != TOTALS]
        made = [(level, rows[0][3], *(WordPart(rows) if level == 1 else GramPart(rows, level)).stored())] if rows else []
        del table
        trim()
        return _kept(made)

    return run


class Level:
    """The distinct histories and n-grams of one level in a piece, and which of them each token has."""

    def __init__(self, columns: list[np.ndarray], history: np.ndarray, symbol: np.ndarray, symbols: int):
        self.columns, self.history = columns, history
        grams, gram = np.unique(history.astype(np.int64) * symbols + symbol, return_inverse=True)
        self.gram = gram.astype(np.int32)
        self.owner, self.word = (x.astype(np.int32) for x in np.divmod(grams, symbols))


class Piece:
    """A piece's texts as numbers, with the totals that came back for its words and n-grams.

    Symbols ascend with the words' numbers in the table; 0 is the start.
    """

    def __init__(self, data: bytes, answers: list[tuple], totals: list[int], parts: int):
        rank, ids, n, doc_ids, train = unpack(data)
        self.n, self.doc_ids, self.train, self.parts = n.astype(np.int64), doc_ids.view(np.int64) if doc_ids.itemsize == 8 else doc_ids.astype(np.int64), train == 1, parts
        self.tokens, self.texts = totals[0], totals[2]
        self.answers: dict[int, list] = {}
        for r in sorted(answers, key=lambda r: r[3]):
            self.answers.setdefault(r[1], []).append((r[3], unpack(r[4])))
        number = np.concatenate([x[0].astype(np.int64) * parts + part + 1 for part, x in self.answers[1]])
        count = np.concatenate([x[1] for _, x in self.answers[1]]).astype(np.int64)
        alone, count = count & 1 == 1, count >> 1
        order = np.argsort(number)
        symbol = np.empty(len(order) + 1, np.int32)
        # From a word's rank in the piece, by its place among the names, to its symbol.
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        symbol[rank.astype(np.int64)] = place
        self.number, self.count, self.alone = np.append(0, number[order]), np.append(0, count[order]), np.append(False, alone[order])
        self.symbol = symbol[ids]
        self.first = np.cumsum(self.n) - self.n
        self.trained = np.repeat(self.train, self.n)
        self.before = self._before(self.symbol, 0)

    def _before(self, x: np.ndarray, start) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = start
        return out

    @staticmethod
    def _numbered(x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct numbers below ``top`` and, of each, its place among them; without a sort."""
        there = np.zeros(top, bool)
        there[x] = True
        return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[x].astype(np.int32)

    def levels(self, last: int):
        """Levels 2 to ``last``, with the n-gram (of level 1: the symbol) one level below that each token has."""
        used, history = self._numbered(self.before, len(self.number))
        columns, below = [used], self.symbol
        for k in range(2, last + 1):
            level = Level(columns, history, self.symbol, len(self.number))
            yield k, level, below
            if k < last:
                # A token's history is the n-gram that ends before it; first is that of starts alone, which continues the first history.
                used, history = self._numbered(self._before(level.gram + np.int32(1), 0), len(level.word) + 1)
                old, symbol = np.append(np.int32(0), level.owner)[used], np.append(np.int32(0), level.word)[used]
                columns, below = [*(c[old] for c in columns), symbol], level.gram

    def own(self, level: Level, below: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Which of a level's histories no other piece has; ``alone`` says so of the n-grams one level below."""
        out = np.zeros(len(level.columns[0]), bool)
        out[level.history] = self._before(alone[below], False)
        return out

    def counts(self, level: Level, below: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each n-gram its trained count in this piece and its total one level below."""
        lower = np.empty(len(level.word), np.int64)
        lower[level.gram] = totals[below]
        return np.bincount(level.gram[self.trained], minlength=len(level.word)), lower

    def layout(self, level: Level, below: np.ndarray, totals: np.ndarray, own: np.ndarray):
        """Where a level's histories and n-grams are asked for, but for the piece's ``own`` histories.

        ``totals`` has the totals one level below.  A history gets a part for each
        share of the tokens that a part has on average.  Returns the entries
        (history, part) in order of parts, the n-grams in the same order, how many
        of them each entry has, and where each part's entries begin.
        """
        often = np.zeros(len(level.columns[0]), np.int64)
        often[level.history] = self._before(totals[below], self.texts)
        spread = np.clip(-(-often * self.parts // max(1, self.tokens)), 1, self.parts)
        spread[own] = 0
        entry = np.repeat(np.arange(len(spread)), spread)
        start = np.cumsum(spread) - spread
        base = (_hash([self.number[c] for c in level.columns]) % np.uint64(self.parts)).astype(np.int64)
        part = (base[entry] + np.arange(len(entry)) - start[entry]) % self.parts
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        grams = np.flatnonzero(~own[level.owner])
        owner = level.owner[grams]
        salt = (mix(self.number[level.word[grams]].astype(np.uint64)) % spread[owner].astype(np.uint64)).astype(np.int64)
        at = place[start[owner] + salt]
        return entry[order], grams[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(order)), np.searchsorted(part[order], np.arange(self.parts + 1))

    def ask(self, k: int, level: Level, below: np.ndarray, totals: np.ndarray, alone: np.ndarray):
        """What each part is asked for, (part, packed), and then the totals of the n-grams of the piece's own histories, (None, totals)."""
        own = self.own(level, below, alone)
        entry, grams, followers, edges = self.layout(level, below, totals, own)
        trained, lower = self.counts(level, below, totals)
        ends = np.append(0, np.cumsum(followers))
        columns = [self.number[c] for c in level.columns]
        for part, (a, b) in enumerate(pairwise(edges)):
            if b > a:
                some = grams[ends[a] : ends[b]]
                first, *more = (c[entry[a:b]] for c in columns)
                yield part, pack(_ascending(first), *more, followers[a:b], self.number[level.word[some]], trained[some], lower[some])
        yield None, trained[own[level.owner]]

    def answer(self, k: int, level: Level, below: np.ndarray, totals: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The totals of a level's n-grams, the stats of its histories and which of the n-grams no other piece has, from the answers and the piece itself."""
        own = self.own(level, below, alone)
        entry, grams, _, _ = self.layout(level, below, totals, own)
        trained, lower = self.counts(level, below, totals)
        here = own[level.owner]
        stats = _stats(level.owner[here], trained[here], lower[here], len(own), k)
        if rows := self.answers.get(k):
            told = np.concatenate([x[0] for _, x in rows]).astype(np.int64)
            trained[grams], here[grams] = told >> 1, told & 1 == 1
            once = len(entry) == len(own) - own.sum()
            for i in range(len(stats)):
                more = np.concatenate([x[i + 1] for _, x in rows])
                if once:
                    stats[i, entry] = more
                else:
                    stats[i] += np.bincount(entry, more, minlength=len(own)).astype(np.int64)
        return trained, stats, here

    def kept(self, k: int, level: Level, below: np.ndarray, totals: np.ndarray, alone: np.ndarray) -> tuple[int, bytes]:
        """The n-grams of the piece's own histories, as a table keeps them."""
        here = np.flatnonzero(self.own(level, below, alone)[level.owner])
        return _entries([self.number[c] for c in level.columns], level.owner[here], self.number[level.word[here]], self.counts(level, below, totals)[0][here])


def _asked(level: int, parts: int, order: int):
    """A piece asks for the n-grams of one level."""

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out, answers = [], _rows(right)
        for row in _rows(left):
            p = Piece(row[4], answers, right.column("totals")[0].as_py(), parts)
            totals, alone = p.count, p.alone
            for k, own, below in p.levels(level):
                if k < level:
                    totals, _, alone = p.answer(k, own, below, totals, alone)
                    continue
                for part, x in p.ask(k, own, below, totals, alone):
                    if part is None:
                        out.append((row[2] % parts, TOTALS, row[2], 0, None, _of_level(order, level, x)))
                    else:
                        out.append((part, level, row[2], part, x, None))
            del p
        trim()
        return _table(out)

    return run


def _katz(ratio: np.ndarray, rest: float) -> np.ndarray:
    """Discounts from the ratios of adjusted to seen counts, given the share of the counts 1 that counts up to the last keep."""
    return (ratio - rest) / (1 - rest) if rest != 1 else np.full(len(ratio), np.nan)


def _line(n: np.ndarray) -> float:
    """Slope of log counts of counts over log counts, each spread over the gap to its neighbours that aren't 0."""
    r = np.flatnonzero(n > 0) + 1
    if len(r) < 2:
        return 0.0
    below, above = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - r[-2])
    return float(np.polyfit(np.log(r), np.log(2 * n[r - 1] / (above - below)), 1)[0])


def discounts(of_counts: list[int]) -> np.ndarray:
    """Good-Turing discounts of the counts 1 to 5 from the numbers of n-grams seen 1 to 6 times.

    From the first count on for which these numbers give none strictly between 0
    and 1, as where texts have copies, numbers smoothed by a line through their
    logarithms do (Simple Good-Turing).  Only where that line doesn't fall faster
    than 1 / r, so that there is no Good-Turing estimate, absolute discounting does.
    """
    n = np.array(of_counts, float)
    r = np.arange(1, DISCOUNTED + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = _katz((r + 1) * n[1:] / n[:-1] / r, (DISCOUNTED + 1) * n[DISCOUNTED] / n[0])
    good = np.logical_and.accumulate((n[:-1] > 0) & (n[1:] > 0) & (d > 0) & (d < 1))
    if good.all():
        return d
    fall = _line(n) + 1
    if fall < 0:
        smooth = _katz(((r + 1) / r) ** fall, (DISCOUNTED + 1.0) ** fall)
        return np.where(good, d, smooth)
    loss = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return (r - loss) / r


def kept_mass(stats: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What counts keep after discounting: stats are how many were seen 1 to 5 times and how often all others."""
    return ((d * np.arange(1, DISCOUNTED + 1))[:, None] * stats[:DISCOUNTED]).sum(0) + stats[DISCOUNTED]


def weights(stats: np.ndarray, d: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each history the divisor of its discounted counts and its backoff weight; weight 1 where it was never seen.

    ``lower`` is what its followers have one level below.  A history none of
    whose counts is discounted keeps one more count for the unseen.
    """
    r = np.arange(1, DISCOUNTED + 1)
    count = (r[:, None] * stats[:DISCOUNTED]).sum(0) + stats[DISCOUNTED]
    kept = kept_mass(stats, d)
    divisor = np.where(kept < count, count, count + 1).astype(float)
    weight = np.where(count > 0, (1 - kept / np.maximum(divisor, 1)) / np.maximum(1 - lower, 1e-300), 1.0)
    return np.maximum(divisor, 1), weight


def _probabilities(p: Piece, totals: list[int], order: int, own: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The model's probability of each distinct n-gram of the longest level, and which one each token has.

    What the piece counted itself is added to ``own``, if given: of each level the
    rows of the tables that are kept, with -1 for a part.
    """
    mass = totals[0] + totals[1] + 1
    probability, of, count, alone = (p.count + 1) / mass, p.symbol, p.count, p.alone
    divisor = d_below = history_below = None
    for k, level, below in p.levels(order):
        if own is not None:
            n, data = p.kept(k, level, below, count, alone)
            if n:
                own.append((k, -1, n, data))
        total, stats, alone = p.answer(k, level, below, count, alone)
        at = 3 + (k - 2) * (DISCOUNTED + 1)
        d = discounts(totals[at : at + DISCOUNTED + 1])
        if k == 2:
            lower = stats[DISCOUNTED + 1] / mass
        else:
            shorter = np.empty(stats.shape[1], np.int64)
            shorter[level.history] = history_below
            lower = kept_mass(stats[DISCOUNTED + 1 :], d_below) / divisor[shorter]
        divisor, weight = weights(stats, d, lower)
        beneath = np.empty(len(level.word))
        beneath[level.gram] = probability[below]
        kept = np.append(np.append(0.0, d), 1.0)[np.minimum(total, DISCOUNTED + 1)] * total
        probability = np.where(total > 0, kept / divisor[level.owner], weight[level.owner] * beneath)
        of, count, d_below, history_below = level.gram, total, d, level.history
    return probability, of


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(parts: int, order: int, keep: bool):
    """Scores of a piece's texts and, to ``keep``, the rows of the tables that the piece counted itself."""
    names = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        tables, own, answers = [], [] if keep else None, _rows(right)
        for row in _rows(left):
            totals = right.column("totals")[0].as_py()
            p = Piece(row[4], answers, totals, parts)
            base = np.log10((p.count + 1) / (totals[0] + totals[1] + 1))
            probability, of = _probabilities(p, totals, order, own)
            text = np.repeat(np.arange(len(p.n)), p.n)
            sums = [np.bincount(text, x, minlength=len(p.n)) for x in (p.count[p.symbol] > 0, base[p.symbol], np.log10(probability)[of])]
            columns = (p.doc_ids, p.n, sums[0].astype(np.int64), np.full(len(p.n), totals[0]), sums[1], sums[2])
            tables.append(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names)))
            del p
        trim()
        made = pa.concat_tables(tables) if tables else pa.Table.from_arrays([pa.array([], t) for t in types], names=list(names))
        return pa.concat_tables([made, _kept(own)], promote_options="default") if keep else made

    return run


def _of_kind(rows: DataFrame, test: str) -> DataFrame:
    """Rows of some kinds, picked behind the shuffle that all kinds share.

    A condition that isn't deterministic, as one expression, is not pushed below
    it; each pushed filter would be a shuffle of its own, and what feeds it would
    run once for each.
    """
    return rows.where(f"if(monotonically_increasing_id() >= 0, {test}, false)")


def scores(docs: DataFrame, train, order: int = ORDER, tables: str | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``train`` is a condition over ``doc_id``; texts that meet it are counted, all
    are scored.  ``base_score`` is the log10 probability under the add-one
    unigram, ``score`` that of the model of n-grams up to ``order``, 2 at least.
    The n-gram tables are kept in the folder ``tables``, if one is named, as Parquet
    partitioned by ``level``; see :func:`stored`.

    Null and empty texts are one end token; rows of one id are scored each, ties
    and repeats alike; null ids count as the smallest long; an empty table gives
    an empty result; other columns are dropped, whatever their names.  A text is
    never cut; one longer than a piece is a piece of its own.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    docs = documents(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(n, size // LEAST_BYTES), -(-size // PART_BYTES))
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    read = docs.mapInArrow(_read(parts, order), ROW).repartition(max(parts, 1), "key")
    piece = _of_kind(read, f"kind = {PIECE}")
    sums = [F.coalesce(F.sum(F.col("numbers")[i]), F.lit(0)) for i in range(3 + (DISCOUNTED + 1) * (order - 1))]

    def with_totals(rows: list[DataFrame]) -> DataFrame:
        """The answers, each beside the one row of totals so far."""
        totals = _of_kind(read, f"kind = {TOTALS}")
        for part in rows:
            totals = totals.unionByName(_of_kind(part, f"kind = {TOTALS}"))
        # All columns are used, so that none is cut below the shuffle, which would make it another one.
        totals, out = totals.agg(F.array(*sums).alias("totals"), F.max(F.struct("key", "pid", "part", F.octet_length("data"))).alias("last")), None
        for part in rows:
            own = _of_kind(part, "kind > 0")
            out = own if out is None else out.unionByName(own)
        return out.join(F.broadcast(totals), F.lit(True))

    kept, answers, asked = [], [], _of_kind(read, "kind = 1")
    for level in range(1, order + 1):
        if level > 1:
            asked = piece.groupBy("key").cogroup(with_totals(answers).groupBy("key")).applyInArrow(_asked(level, parts, order), ROW).repartition(parts, "key")
        if tables:
            kept.append(asked.groupBy("key").applyInArrow(_stored(level), TABLE))
        counted = asked.groupBy("key").applyInArrow(_counted(level, order), ROW).repartition(parts, "key")
        answers.append(counted)
    scored = piece.groupBy("key").cogroup(with_totals(answers).groupBy("key")).applyInArrow(_score(parts, order, bool(tables)), f"{SCORES}, {TABLE}" if tables else SCORES)
    # Rows without a level are scores; what pieces counted themselves comes with them.
    out = scored.withColumn("level", F.coalesce("level", F.lit(0)) if tables else F.lit(0))
    for table in kept:
        out = out.unionByName(table, allowMissingColumns=True)
    folder = tables or scratch(spark, "katz")
    # Scores and tables in one job, so that the parts are dealt once.
    out.write.partitionBy("level").option("compression", "zstd").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder).where("level = 0").select(*(c.split()[0] for c in SCORES.split(", ")))


def stored(spark, folder: str) -> DataFrame:
    """The tables that :func:`scores` kept: ``level``, ``part``, ``n_entries`` and the packed ``data`` of each part."""
    schema = TABLE.replace("level int, ", "") + ", level int"
    return spark.read.schema(schema).parquet(folder).where("level > 0").select("level", "part", "n_entries", "data")
