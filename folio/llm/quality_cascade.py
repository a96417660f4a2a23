"""Quality rules as a short-circuit cascade.

Each rule rejects a text by one cheap figure.  On a bounded sample the cascade
measures what a rule costs and how often it rejects, and orders the rules by
rejections per cost; a rule then sees only texts that all before it let pass.
The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import IS_SPACE, Words, bytes_of, documents, mix, pieces, span_hashes, starts_within, windows

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: Rows from which cost and selectivity are estimated, and their longest text in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 32_768

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LOWER_ASCII = np.isin(np.arange(256), list(range(97, 123)))
_BANG = np.arange(256) == 33
_HEAD = (np.arange(256) & 0xC0) != 0x80


class Texts:
    """A batch of texts and what the rules look at; each part is made when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: Words | None = None):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.words = Words(data, offsets, IS_SPACE) if words is None else words
        self.n_words = self.words.counts()
        self.memo: dict[str, np.ndarray] = {}

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        at = np.flatnonzero(flags)
        return np.diff(np.searchsorted(at, self.offsets))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def get(self, name: str) -> np.ndarray:
        if name not in self.memo:
            self.memo[name] = FIGURES[name](self)
        return self.memo[name]

    def take(self, rows: np.ndarray) -> Texts:
        """These rows as a batch of their own."""
        keep = np.zeros(self.n, bool)
        keep[rows] = True
        size = np.diff(self.offsets)
        stay, offsets = np.repeat(keep, size), np.concatenate([[0], np.cumsum(size[keep])])
        # The words stay what they are, at other places.
        words, own = Words.__new__(Words), np.repeat(keep, self.n_words)
        back = np.repeat(self.offsets[:-1][keep] - offsets[:-1], self.n_words[keep])
        words.inside, words.hash = self.words.inside[stay], self.words.hash[own]
        words.starts, words.ends = self.words.starts[own] - back, self.words.ends[own] - back
        words.first = np.concatenate([[0], np.cumsum(self.n_words[keep])])
        return Texts(self.data[stay], offsets, words)


def _dup_lines(t: Texts) -> np.ndarray:
    starts = np.union1d(t.offsets[:-1], np.flatnonzero(t.data == 10) + 1)
    starts = starts[starts < len(t.data)]
    text = np.searchsorted(t.offsets, starts, "right") - 1
    ends = np.append(starts[1:], len(t.data))[: len(starts)]
    ends = ends - (t.data[ends - 1] == 10)
    worded = np.searchsorted(t.words.starts, ends) > np.searchsorted(t.words.starts, starts)
    starts, ends, text = starts[worded], ends[worded], text[worded]
    _, first = np.unique(np.stack([text.astype(np.uint64), span_hashes(t.data, starts, ends)], 1), axis=0, return_index=True)
    return np.bincount(text, minlength=t.n) - np.bincount(text[first], minlength=t.n)


def _repeat_words(t: Texts) -> np.ndarray:
    n = len(t.words.hash)
    good = starts_within(t.words.first, WINDOW, n)
    text = t.text_of_word()
    at = np.flatnonzero(good)
    key = mix(windows(t.words.hash, WINDOW)[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    at = at[count[inverse] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + WINDOW, n), -1)
    covered = np.cumsum(edge[:n]) > 0
    return np.bincount(text[covered], minlength=t.n)


def _top_word(t: Texts) -> np.ndarray:
    text = t.text_of_word()
    pairs, count = np.unique(np.stack([text.astype(np.uint64), t.words.hash], 1), axis=0, return_counts=True)
    top = np.zeros(t.n, np.int64)
    np.maximum.at(top, pairs[:, 0].astype(np.int64), count)
    return top


def _stutters(t: Texts) -> np.ndarray:
    same = t.words.hash[1:] == t.words.hash[:-1]
    same &= starts_within(t.words.first, 2, len(t.words.hash))
    return np.bincount(t.text_of_word()[1:][same], minlength=t.n)


#: What can be measured of a text.
FIGURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": lambda t: t.n_words,
    "word_chars": lambda t: t.per_text(t.words.inside & _HEAD[t.data]),
    "n_symbols": lambda t: t.per_text(_SYMBOL[t.data]),
    "n_upper": lambda t: t.per_text(_UPPER[t.data]),
    "n_lower": lambda t: t.per_text(_LOWER_ASCII[t.data]),
    "n_bangs": lambda t: t.per_text(_BANG[t.data]),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "top_word": _top_word,
    "n_stutters": _stutters,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``test`` holds; ``test`` gets a function that gives a figure by name."""

    name: str
    test: Callable[[Callable[[str], np.ndarray]], np.ndarray] = field(compare=False)


#: The rules of production, compared in whole numbers.
RULES = (
    Rule("symbols", lambda f: 5 * f("n_symbols") > f("n_words")),
    Rule("capitals", lambda f: 2 * f("n_upper") > f("n_lower")),
    Rule("exclamations", lambda f: 5 * f("n_bangs") > f("n_words")),
    Rule("word_length", lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 20 * f("n_words"))),
    Rule("one_word", lambda f: 5 * f("top_word") > 2 * f("n_words")),
    Rule("stutter", lambda f: 10 * f("n_stutters") > 3 * f("n_words")),
    Rule("dup_lines", lambda f: 20 * f("n_dup_lines") > f("n_words")),
)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def cascade(texts: Texts, rules) -> np.ndarray:
    """Which texts pass all rules; each rule sees only the texts left by those before."""
    alive = np.arange(texts.n)
    for rule in rules:
        if not len(alive):
            break
        bad = rule.test(texts.get)
        if bad.any():
            alive, texts = alive[~bad], texts.take(np.flatnonzero(~bad))
    return alive


def estimate(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Each rule with its cost (seconds a text) and share of rejections, on ``sample_rows`` rows at most."""
    rows = documents(docs).where(F.octet_length("text") <= SAMPLE_BYTES).limit(sample_rows).collect()
    data = [r["text"].encode() for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    out = []
    for rule in rules:
        texts = Texts(np.frombuffer(b"".join(data), np.uint8), offsets)
        began = time.perf_counter()
        bad = rule.test(texts.get)
        out.append((rule, (time.perf_counter() - began) / max(1, len(rows)), float(np.mean(bad)) if len(bad) else 0.0))
    return out


def order(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejections per cost."""
    return [rule for rule, _, _ in sorted(estimate(docs, rules, sample_rows), key=lambda x: -x[2] / max(x[1], 1e-9))]


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(rules):
    def run(batches):
        for batch in pieces(batches, 512, 1 << 20):
            texts = Texts(*bytes_of(batch.column(1)))
            base = {x: texts.get(x).astype(np.int64) for x in _BASE}
            failed = base_failed(base["n_words"], base["n_repeat_words"])
            kept = np.zeros(texts.n, bool)
            rest = np.flatnonzero(~failed)
            kept[rest[cascade(texts.take(rest), rules)]] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(base[x]) for x in _BASE), pa.array(failed), pa.array(kept)], ["doc_id", *_BASE, "base_failed", "kept"])

    return run


def quality(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: the base figures, ``base_failed`` and ``kept``.

    Words are runs of anything but ASCII white space.  Null and empty texts have
    no words and fail the base.  Repeated rows are judged each, a null ``doc_id``
    stays null, an empty table gives an empty result, other columns are dropped,
    whatever their names.  Texts of any length are measured whole; figures that
    equal a rule's bound pass.
    """
    schema = "doc_id long, " + ", ".join(f"{x} long" for x in _BASE) + ", base_failed boolean, kept boolean"
    return documents(docs).mapInArrow(_measure(order(docs, rules, sample_rows)), schema)


def _judge(rules):
    def run(batches):
        for batch in pieces(batches, 512, 1 << 20):
            column = batch.column(batch.schema.get_field_index("text"))
            texts = Texts(*bytes_of(column))
            rest = np.flatnonzero(~base_failed(texts.n_words, texts.get("n_repeat_words")))
            yield batch.take(pa.array(rest[cascade(texts.take(rest), rules)]))

    return run


def keep_good(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that pass; see :func:`quality`."""
    return docs.mapInArrow(_judge(order(docs, rules, sample_rows)), docs.schema)
