"""Source divergence, neighbour votes and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import neighbour_vote, periodic_runs, queries, source_divergence

WORD = r"[^\x20\x09-\x0D]+"


# Periodic runs.
def plain_runs(x, min_length=12, exponent=2):
    out = {}
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, exponent * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def number_lists(seed):
    r = random.Random(seed)
    for _ in range(r.randint(1, 4)):
        n, x = r.choice([0, 1, 11, 12, 40, 150, 700]), []
        x = [r.randrange(r.choice([1, 2, 3, 12, 900])) for _ in range(n)]
        for _ in range(r.randint(0, 3) if n > 20 else 0):
            a, p = r.randrange(n), r.choice([1, 2, 5, 16, 17, 40, 100, 200])
            for i in range(a + p, min(n, a + p + r.randrange(n))):
                x[i] = x[i - p]
        yield np.array(x, np.int64)


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_numbers(seed):
    lists = list(number_lists(seed))
    want = [plain_runs(list(x)) for x in lists]
    assert periodic_runs.runs_of(lists) == want
    # Parts of the lags together find the same, a lag's multiples aside.
    least = [{} for _ in lists]
    for part in range(3):
        for found, runs in zip(least, periodic_runs.runs_of(lists, part=part, parts=3), strict=True):
            for start, length, period in runs:
                found[start, length] = min(period, found.get((start, length), period))
    assert [sorted(((s, n, p) for (s, n), p in x.items()), key=lambda r: (r[0], r[2])) for x in least] == want


def test_other_bounds():
    x = [1, 2, 3] * 3 + [9] + [5, 6] * 8
    assert periodic_runs.runs_of([np.array(x)], 6, 3) == [plain_runs(x, 6, 3)] == [[(0, 9, 3), (10, 16, 2)]]


def plain_rows(rows):
    out = []
    for i, text in rows:
        ws = re.findall(WORD, text or "")
        runs = plain_runs(ws)
        gone = {j for s, n, p in runs for j in range(s + p, s + n)}
        out.append((i, len(ws), tuple(runs), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return Counter(out)


ODD = [(1, "a b " * 9), (1, "a b " * 9), (2, ""), (3, None), (None, "x " * 13), (None, None), (4, "no run here"), (5, "t " * 5 + "one two " * 12), (6, " ".join(f"w{i % 700}" for i in range(2500)))]


@pytest.mark.parametrize("range_bytes", [1 << 16, 20])
def test_periodic_runs(spark, range_bytes):
    rows = [*ODD, *((100 + s, " ".join(f"w{w}" for w in x)) for s in range(8) for x in number_lists(s))]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, key string, runs int").repartition(3)
    out = periodic_runs.periodic_runs(docs, range_bytes=range_bytes)
    got = Counter((r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["text"]) for r in out.collect())
    assert got == plain_rows(rows)
    assert periodic_runs.periodic_runs(docs.limit(0), range_bytes=range_bytes).count() == 0


def test_the_query_repeats_words_as_asked(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, None if i == 5 else " ".join(r.choice("abc") if i % 2 else f"w{r.randrange(500)}" for _ in range(r.choice([0, 3, 60, 400])))) for i in range(120)]
    spark.createDataFrame([*rows, (None, "z " * 20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in [*rows, (None, "z " * 20)]:
        ws = re.findall(WORD, text or "")
        n, h = len(ws), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[j] if j < a else ws[a + (j - a) % p] for j in range(n)]
        runs = plain_runs(ws)
        gone = {j for s, m, p in runs for j in range(s + p, s + m)}
        best = min(((-m, s, p) for s, m, p in runs), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        figures = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        want.append((i, len(runs), *figures, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(w for j, w in enumerate(ws) if j not in gone))))
    out = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert Counter(tuple(x[c] for c in names) for x in out) == Counter(want)


# Source divergence.
def plain_divergence(rows, min_docs=10, top=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({(lang or "", source or "") for _, lang, source in rows})
    for text, lang, source in rows:
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold)))
        count[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        others = [s for name, s in groups if name == lang and s != source]
        whole = Counter()
        for s in [source, *others]:
            whole.update(count[lang, s])

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        own, mean = shares(count[lang, source]), shares(whole)
        far = [(s, sum(f(own[t], p) for t, p in shares(count[lang, s]).items())) for s in others]
        terms = [(t, f(own[t], mean[t])) for t in kept if count[lang, source][t] and own[t] > mean[t]]
        for part, found, most in (("pair", far, len(far)), ("term", terms, top)):
            ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(ordered[:most], 1)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_source_divergence(spark, seed):
    r = random.Random(seed)
    words = ["The", "the", "ÄÖ", "äö", "naïve", "x1y", "Z"] + [f"w{chr(97 + i)}" for i in range(14)]
    rows = [(" ".join(r.choice(words[: r.randint(3, len(words))]) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "d", None])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "en", "é"), ("rare words only", "xx", "one"), (None, "xx", "two"), ("42 !", "yy", "alone")]
    docs = spark.createDataFrame([(t, lang, s, 1, "x") for t, lang, s in rows], "text string, lang string, source string, n int, term string").repartition(3)
    out = source_divergence.divergence(docs)
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows)
    assert source_divergence.divergence(docs.limit(0)).count() == 0


# Neighbour votes.
def labelled(seed, n=400):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        words = [r.choice("of the and to in that was for with on as this are".split()) if r.random() < 0.5 else "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8))) for _ in range(r.randint(30, 120))]
        rows.append((i, " ".join(w if good else w.upper() + r.choice("!#$") for w in words)))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    got = {r["doc_id"]: r["score"] for r in neighbour_vote.scores(docs, known, learn, train_rows=200).collect()}
    held = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(rows) and held and all((got[i] >= 0.3) == bool(q) for i, q in held)
    # What is held out is not learnt from: other labels there change nothing.
    turned = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels], "doc_id long, quality int")
    again = {r["doc_id"]: r["score"] for r in neighbour_vote.scores(docs, turned, learn, train_rows=200).collect()}
    assert all(abs(got[i] - again[i]) < 1e-6 for i in got)


def test_votes_are_exact_weighted_neighbours(spark):
    """Scores equal a plain average over the most similar labelled vectors."""
    rows, labels = labelled(2, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = neighbour_vote.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True), train_rows=60, rank=16, neighbours=7)
    assert model.vectors.shape == (60, 16)
    import pyarrow as pa

    texts = [t for _, t in rows[:40]] + ["", None]
    b = neighbour_vote.bags(pa.array(texts))
    vectors = neighbour_vote.unit(neighbour_vote.projected(b, neighbour_vote.weighted(b, model.idf), model.factors))
    for v, score in zip(vectors, model.scores(pa.array(texts)), strict=True):
        near = sorted(((float(v @ u), float(q)) for u, q in zip(model.vectors, model.labels, strict=True)), reverse=True)[:7]
        if near[-1][0] > 0:
            assert abs(score - sum(s * q for s, q in near) / sum(s for s, _ in near)) < 1e-3


def test_votes_on_odd_rows(spark):
    rows, labels = labelled(3, 60)
    odd = [*rows, (1, "again"), (None, "x"), (None, None), (500, ""), (501, None), (502, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in odd], "doc_id long, text string, label int, score string").repartition(3)
    known = spark.createDataFrame([*labels, (1, 0), (None, 1), (2, None), (9999, 1)], "doc_id long, quality int")
    out = neighbour_vote.scores(docs, known, F.lit(True))
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in odd) and all(0 <= r["score"] <= 1 for r in got)
    assert neighbour_vote.scores(docs.limit(0), known, F.lit(True)).count() == 0
    assert {r["score"] for r in neighbour_vote.scores(docs, known.limit(0), F.lit(True)).collect()} == {0.5}
