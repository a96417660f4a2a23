"""Quality by nearest neighbours in a latent-semantic space.

A text is a bag of terms: its words, folded to lower case and hashed into
``WORD_BINS``, and the shapes of its words (what kinds of characters they hold,
their length, whether they repeat the word before), hashed into ``SHAPE_BINS``.
Document frequencies are counted over all documents.  The factors of the
weighted term matrix are fitted on labelled texts, a bounded sample of them; each
labelled text becomes a vector of ``rank`` numbers.  These, at most ``train_rows``
of them, are broadcast with the bins' factors, and every document is compared
with all of them, in blocks of exact cosine products.  Of the ``neighbours``
most similar ones (more where the last ones tie) the labels are averaged, weighted
by similarity.

Null and empty texts have one term, as every text has, and are scored by it.
Null ids are scored like others and never labelled.  Of rows with one id, the
least text and the least label are learnt from.  Without any labelled row the
score is 1/2.  An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import LOWER, Words, bytes_of, documents, pieces

WORD_BINS, SHAPE_BINS = 1 << 14, 1 << 11
#: Words, shapes, and one term that all texts have.
BINS = WORD_BINS + SHAPE_BINS + 1
MAX_NEIGHBOURS_BLOCK = 256


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


#: Kinds of bytes in a word: capitals, small letters and all beyond ASCII, digits, marks of layout, other punctuation.
_KINDS = (
    _class(bytes(range(65, 91))), _class(bytes(range(97, 123)) + bytes(range(128, 256))), _class(bytes(range(48, 58))), _class(b"#*$%&|<>"),
    _class(bytes(i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "#*$%&|<>")),
)


def shapes(data: np.ndarray, words: Words) -> np.ndarray:
    """A number below ``SHAPE_BINS`` for each word's shape."""
    out = np.zeros(len(words.starts), np.int64)
    for kind, most in zip(_KINDS, (2, 1, 1, 3, 3), strict=True):
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        out = out * (most + 1) + np.minimum(total[words.ends] - total[words.starts], most)
    size = np.searchsorted([3, 8, 16], words.ends - words.starts, "right")
    again = np.zeros(len(out), np.int64)
    if len(out) > 1:
        again[1:] = words.hash[1:] == words.hash[:-1]
        cuts = words.first[1:-1]
        again[cuts[(cuts > 0) & (cuts < len(again))]] = 0
    return (out * 4 + size) * 2 + again


@dataclass
class Bags:
    """Term counts of a batch: entries ``first[i]:first[i + 1]`` of ``bins`` and ``counts`` are text i's."""

    first: np.ndarray
    bins: np.ndarray
    counts: np.ndarray


def bags(texts: pa.Array) -> Bags:
    data, offsets = bytes_of(texts)
    words = Words(data, offsets, fold=LOWER)
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), words.counts())
    every = np.arange(n) * np.int64(BINS) + (BINS - 1)
    word = text * np.int64(BINS) + (words.hash % np.uint64(WORD_BINS)).astype(np.int64)
    shape = text * np.int64(BINS) + WORD_BINS + shapes(data, words) % SHAPE_BINS
    keys, counts = np.unique(np.concatenate([word, shape, every]), return_counts=True)
    return Bags(np.searchsorted(keys, np.arange(n + 1) * np.int64(BINS)), keys % BINS, counts)


def weighted(b: Bags, idf: np.ndarray) -> np.ndarray:
    """Weights of a bag's entries, each text's of length 1."""
    w = ((1 + np.log(b.counts)) * idf[b.bins]).astype(np.float32)
    return w / np.repeat(np.sqrt(np.add.reduceat(w * w, b.first[:-1])), np.diff(b.first))


def projected(b: Bags, w: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Bags times a matrix of the bins, a few hundred thousand entries at a time."""
    out = np.empty((len(b.first) - 1, factors.shape[1]), np.float32)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(b.first, b.first[at] + 200_000, "right")) - 1)
        low, high = b.first[at], b.first[to]
        out[at:to] = np.add.reduceat(factors[b.bins[low:high]] * w[low:high, None], b.first[at:to] - low, axis=0)
        at = to
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-12))


def latent_factors(b: Bags, w: np.ndarray, rank: int, seed: int = 0, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of the bags' matrix, by randomised subspace iteration."""
    rows = len(b.first) - 1
    row = np.repeat(np.arange(rows), np.diff(b.first))
    by_bin = np.argsort(b.bins, kind="stable")
    turned = Bags(np.searchsorted(b.bins[by_bin], np.arange(BINS + 1)), row[by_bin], b.counts[by_bin])
    full = np.flatnonzero(np.diff(turned.first))
    turned.first = np.concatenate([turned.first[full], turned.first[-1:]])
    width = min(rank + 10, rows)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((rows, width)).astype(np.float32))[0]
    for _ in range(rounds):
        right = np.zeros((BINS, width), np.float32)
        right[full] = projected(turned, w[by_bin], basis)
        right = np.linalg.qr(right)[0]
        left = projected(b, w, right)
        basis = np.linalg.qr(left)[0]
    _, _, turn = np.linalg.svd(left, full_matrices=False)
    return np.ascontiguousarray((right @ turn.T)[:, :rank])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each bin occurs, and how many texts there are: ``BINS`` numbers, whatever the input's size."""

    def count(batches):
        total = np.zeros(BINS, np.int64)
        for batch in pieces(batches):
            total += np.bincount(bags(batch.column(0)).bins, minlength=BINS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bin", "n"])

    rows = documents(docs).select("text").mapInArrow(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BINS, np.int64)
    out[rows["bin"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out, int(out[-1])


@dataclass
class Model:
    """What a fitted classifier is: weights and factors of the bins, vectors and labels of the labelled texts."""

    idf: np.ndarray
    factors: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        b = bags(texts)
        vectors = unit(projected(b, weighted(b, self.idf), self.factors))
        k = min(self.neighbours, len(self.labels))
        out = []
        for at in range(0, len(vectors), MAX_NEIGHBOURS_BLOCK):
            near = np.maximum(vectors[at : at + MAX_NEIGHBOURS_BLOCK] @ self.vectors.T, 0)
            least = np.partition(near, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
            near[near < least[:, None]] = 0
            near += np.float32(1e-9)
            out.append((near @ self.labels).astype(np.float64) / near.sum(axis=1))
        return np.clip(np.concatenate(out), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, train_rows: int = 4096, rank: int = 64, neighbours: int = 15) -> Model:
    """A classifier from ``labels`` (doc_id, quality), of those ids for which ``learn`` holds.

    Of more labelled rows than ``train_rows``, those with the least hash of their
    id are taken: the bound of what is gathered, broadcast and compared.
    """
    frequency, texts = document_frequencies(docs)
    idf = np.log((1 + texts) / (1 + frequency)) + 1
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("label"))
    found = documents(docs).where("doc_id is not null").select("doc_id").distinct().join(known, "doc_id")
    sample = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # At most train_rows ids and labels.
    texts_of = documents(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))

    def sparse(batches):
        for batch in pieces(batches):
            b = bags(batch.column(2))
            lists = [pa.LargeListArray.from_arrays(pa.array(b.first.astype(np.int64)), pa.array(x.astype(np.int32))) for x in (b.bins, b.counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(x.cast(pa.list_(pa.int32())) for x in lists)], ["doc_id", "label", "bins", "counts"])

    rows = texts_of.mapInArrow(sparse, "doc_id bigint, label double, bins array<int>, counts array<int>").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return Model(idf, np.zeros((BINS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), neighbours)
    bins, counts = (rows[c].combine_chunks() for c in ("bins", "counts"))
    b = Bags(bins.offsets.to_numpy().astype(np.int64), bins.values.to_numpy().astype(np.int64), counts.values.to_numpy().astype(np.int64))
    w = weighted(b, idf)
    factors = latent_factors(b, w, rank)
    return Model(idf, factors, unit(projected(b, w, factors)), np.clip(rows["label"].to_numpy(), 0, 1).astype(np.float32), neighbours)


def scores(docs: DataFrame, labels: DataFrame, learn: Column, **bounds) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher where label 1 is likelier) of every row; ``bounds`` as for :func:`fit`."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, learn, **bounds))

    def score(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(batch.column(1)), pa.float64())], ["doc_id", "score"])

    return documents(docs).mapInArrow(score, "doc_id bigint, score double")
