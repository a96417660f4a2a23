"""How far the sources of a language are apart in their words, and which words set a source apart.

Terms are runs of letters (ASCII ones lower-cased, all beyond ASCII as they
are); a language keeps those that ``min_docs`` of its documents hold.  A group's
share of a term is smoothed, ``p = 1 + floor(1e9 * (count + 2) / (N + 2 V))``, and
two shares are ``f = floor((p - q)^2 / (p + q))`` apart.  All numbers are whole.

The sum of f over all V terms is not formed term by term.  For a pair (a, b) it
starts at V times f of two zero counts.  The postings of the inverted index add
only corrections: what a's own counts change while b's is zero (one sum a pair,
from the table of a's distinct counts, as equal counts correct alike), the same
for b, and, where a term's posting holds both, the rest that those two leave.

Batches count their own (source, term) pairs before anything is shuffled; the
words that every batch has are summed before they are dealt by term.

Null text, language and source count as ''.  Repeated rows count each.  Groups
without terms are groups; a language without terms has sums of 0 and no terms
to rank.  An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import LOWER, Words, bytes_of, pieces, written

IS_NO_LETTER = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])
SCALE = 1_000_000_000
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of each (language, source, term) of a batch how often it occurs and in how many documents."""
    data, offsets = bytes_of(batch.column(2))
    words = Words(data, offsets, IS_NO_LETTER, hashed=False)
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(words.starts), pa.py_buffer(ends), pa.py_buffer(LOWER[data[words.inside]])).dictionary_encode()
    code, distinct = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(terms.dictionary) or 1
    names: dict[tuple[str, str], int] = {}
    group = np.array([names.setdefault(x, len(names)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
    # Once for each term of each document, then for each term of each group.
    text = np.repeat(np.arange(batch.num_rows, dtype=np.int64), words.counts())
    own, often = np.unique(text * distinct + code, return_counts=True)
    keys, at = np.unique(group[own // distinct] * distinct + own % distinct, return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, often)
    names_of = list(names)
    which = pa.array(keys // distinct)
    langs, sources = (pa.array([x[k] for x in names_of], pa.string()).take(which) for k in (0, 1))
    term = terms.dictionary.cast(pa.string()).take(pa.array(keys % distinct)) if len(keys) else pa.array([], pa.string())
    return pa.RecordBatch.from_arrays([langs, sources, term, pa.array(n), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def named(docs: DataFrame) -> DataFrame:
    """Only ``lang``, ``source`` and ``text``, nulls as ''."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` occurrences in ``docs`` documents; texts never leave their batch."""

    def count(batches):
        for batch in pieces(batches, 1 << 16, batch_bytes):
            yield _counts(batch)

    return named(docs).mapInArrow(count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_postings(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """The inverted index: ``lang``, ``term``, ``source`` and its count ``n`` in ``docs`` documents, with the language's count ``lang_n`` and the number of ``sources``, of the terms kept."""
    dealt = term_counts(docs).repartition("lang", "term")
    kept = dealt.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n"), F.count("source").alias("sources")).where(F.col("in_docs") >= min_docs)
    # Both sides take all columns, so that one exchange, and one pass over the texts, serves both; the kept terms are the lesser side.
    return dealt.join(kept.hint("shuffle_hash"), ["lang", "term"]).select("lang", "term", "source", "n", "docs", "lang_n", "sources", "in_docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a count, in units of 1e-9; decimals, as counts may pass 9e9."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * terms))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Part ``pair``: every other source of the language by its distance, all ranks.
    Part ``term``: the ``top`` terms that are more frequent in the source than in
    its language, by their distance.
    """
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    postings = written(kept_postings(docs, min_docs), "postings")
    langs = postings.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = share(F.lit(0), F.col("total"), F.col("terms"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = written(groups.withColumn("p0", F.when(F.col("terms") > 0, zero).otherwise(1)), "groups")

    shares = postings.join(groups, ["lang", "source"]).select("lang", "term", "source", "n", "lang_n", "terms", "lang_total", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    a, b = (groups.select("lang", F.col("source").alias(f"{x}"), F.col("p0").alias(f"{x}0"), "terms") for x in "ab")
    pairs = a.join(b.drop("terms"), "lang").where("a <> b").withColumn("base", F.col("terms") * apart(F.col("a0"), F.col("b0")))

    # Equal counts of a source correct alike, whatever the term.
    alike = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("times"))
    single = alike.join(pairs.select("lang", "a", "b", "a0", "b0"), ["lang", "a"])
    single = single.withColumn("value", F.col("times") * (apart(F.col("p"), F.col("b0")) - apart(F.col("a0"), F.col("b0")))).where("value <> 0").select("lang", "a", "b", "value")
    one, two = (shares.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p{x}"), F.col("p0").alias(f"z{x}")) for x in "ab")
    p, q, p0, q0 = (F.col(c) for c in ("pa", "pb", "za", "zb"))
    joint = one.join(two, ["lang", "term"]).where("a < b").withColumn("value", apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)).where("value <> 0")
    joint = joint.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    turned = lambda x: x.unionByName(x.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    corrections = turned(single.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).unionByName(joint))
    sums = pairs.select("lang", "a", "b", F.col("base").alias("value")).unionByName(corrections).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pair = sums.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    mean = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    term = shares.where(F.col("n") > 0).withColumn("q", mean).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(best))
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top))
