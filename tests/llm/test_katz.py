"""The language model against a plain version."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import katz_lm


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


class Plain:
    def __init__(self, texts, order=3):
        self.order, self.c = order, Counter()
        self.cc = {k: Counter() for k in range(2, order + 1)}
        for t in texts:
            ws = tokens(t)
            self.c.update(ws)
            for k in self.cc:
                self.cc[k].update((h, w) for h, w in self.grams(ws, k))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d, self.h, self.after = {}, {}, {}
        for k, cc in self.cc.items():
            of = Counter(cc.values())
            self.d[k] = katz_lm.discounts([of[r] for r in range(1, 7)])
            self.h[k], self.after[k] = Counter(), defaultdict(list)
            for (h, w), r in cc.items():
                self.h[k][h] += r
                self.after[k][h].append(w)

    @staticmethod
    def grams(ws, k):
        padded = ["<s>"] * (k - 1) + ws
        return [(tuple(padded[i : i + k - 1]), padded[i + k - 1]) for i in range(len(ws))]

    def unigram(self, w):
        return (self.c[w] + 1) / (self.n + self.v + 1)

    def kept(self, k, r):
        return self.d[k][r - 1] * r if r <= 5 else r

    def p(self, w, h):
        k = len(h) + 1
        if k == 1:
            return self.unigram(w)
        if not self.h[k][h]:
            return self.p(w, h[1:])
        kept = sum(self.kept(k, self.cc[k][h, x]) for x in self.after[k][h])
        total = self.h[k][h] if kept < self.h[k][h] else self.h[k][h] + 1
        if self.cc[k][h, w]:
            return self.kept(k, self.cc[k][h, w]) / total
        return (1 - kept / total) / (1 - sum(self.p(x, h[1:]) for x in self.after[k][h])) * self.p(w, h[1:])

    def score(self, t):
        return sum(math.log10(self.p(w, h)) for h, w in self.grams(tokens(t), self.order))


def rows(seed):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.6)) % 60}" for _ in range(300)]
    out = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(60)]
    return [*out, (100, None), (101, ""), (102, "W1 W1 É"), (4, out[4][1])]


@pytest.mark.parametrize(("seed", "order", "least", "piece"), [(1, 2, 1 << 20, 1 << 24), (2, 3, 100, 300), (3, 3, 1 << 20, 1 << 24), (4, 4, 700, 1000)])
def test_scores(spark, seed, order, least, piece, tmp_path, monkeypatch):
    """One part and many, one piece and many: hot histories are split over parts and added up again."""
    monkeypatch.setattr(katz_lm, "PIECE_BYTES", piece)
    monkeypatch.setattr(katz_lm, "PART_BYTES", least)
    data = rows(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, key string").repartition(3)
    got = sorted(katz_lm.scores(docs, F.col("doc_id") % 4 != 2, order, f"file://{tmp_path}/tables").collect(), key=lambda r: (r["doc_id"], r["n_tokens"]))
    m = Plain([t for i, t in data if i % 4 != 2], order)
    assert len(got) == len(data)
    for r, (i, t) in zip(got, sorted(data, key=lambda x: (x[0], len(tokens(x[1])))), strict=True):
        ws = tokens(t)
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, len(ws), sum(m.c[w] > 0 for w in ws), m.n)
        assert math.isclose(r["base_score"], sum(math.log10(m.unigram(w)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r["score"], m.score(t), rel_tol=1e-9)
    kept = {r["level"]: r["n"] for r in katz_lm.stored(spark, f"file://{tmp_path}/tables").groupBy("level").agg(F.sum("n_entries").alias("n")).collect()}
    assert {k: n for k, n in kept.items() if k > 1} == {k: len(cc) for k, cc in m.cc.items()}
    for part in katz_lm.stored(spark, f"file://{tmp_path}/tables").where("level = 2").collect():
        _, followers, words, counts = katz_lm.unpack(part["data"])
        assert followers.sum() == len(words) == len(counts) == part["n_entries"]


def test_plain_model_sums_to_one():
    m = Plain([t for _, t in rows(3)])
    for h in [("<s>", "<s>"), *list(m.h[3])[:40], ("never", "w1"), ("w1", "never")]:
        assert math.isclose(sum(m.p(w, h) for w in [*m.c, "unknown"]), 1, rel_tol=1e-9)


def test_no_training_texts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = katz_lm.scores(docs, F.lit(False)).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
    assert katz_lm.scores(docs.where("doc_id > 5"), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [[1577239, 246764, 51785, 21749, 18965, 7618], [193550, 25112, 6501, 2183, 2502, 616]])
def test_good_turing_where_copies_bend_the_counts_of_counts(n):
    """The counts of counts of the given documents at sf0.1 and sf0.01: only from the fourth on no discount."""
    d = katz_lm.discounts(n)
    rest = 6 * n[5] / n[0]
    turing = [((r + 1) * n[r] / n[r - 1] / r - rest) / (1 - rest) for r in range(1, 6)]
    assert np.allclose(d[:3], turing[:3]) and turing[3] > 1
    # The line by the normal equations.
    xs, ys = [math.log(r) for r in range(1, 7)], [math.log(x) for x in n]
    mx, my = sum(xs) / 6, sum(ys) / 6
    c = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs) + 1
    assert np.allclose(d[3:], [(((r + 1) / r) ** c - 6**c) / (1 - 6**c) for r in (4, 5)])
    assert ((d > 0) & (d < 1)).all()


def test_good_turing_on_documents_with_copies(spark):
    r = random.Random(11)
    texts = [" ".join(f"w{int(r.paretovariate(0.5)) % 4000}" for _ in range(60)) for _ in range(40)]
    data = list(enumerate([*texts, *[t for t in texts[:6] for _ in range(4)]]))
    m = Plain([t for _, t in data], 2)
    of = Counter(m.cc[2].values())
    n = [of[k] for k in range(1, 7)]
    rest = 6 * n[5] / n[0]
    turing = [((k + 1) * n[k] / n[k - 1] / k - rest) / (1 - rest) for k in range(1, 6)]
    assert not all(0 < x < 1 for x in turing) and 0 < turing[0] < 1
    m.d[2] = [turing[0], *m.d[2][1:]]
    got = {x["doc_id"]: x["score"] for x in katz_lm.scores(spark.createDataFrame(data, "doc_id long, text string"), F.lit(True), 2).collect()}
    for i, t in data:
        assert math.isclose(got[i], m.score(t), rel_tol=1e-9)


@pytest.mark.parametrize("n", [[0, 40, 0, 9, 0, 3], [90, 0, 7, 3, 2, 1], [5, 6, 7, 8, 9, 10], [0, 0, 0, 0, 0, 0], [60, 10, 10, 10, 10, 10], [600, 100, 40, 20, 12, 0]])
def test_discounts_stay_between_0_and_1(n):
    d = katz_lm.discounts(n)
    assert len(d) == 5 and ((d > 0) & (d < 1)).all()


def test_packing():
    r = np.random.default_rng(1)
    many = [r.integers(0, 9, 1000), np.array([1 << 40, 3]), np.zeros(0, np.int64), np.array([300, 0]), np.array([2**64 - 1], np.uint64)]
    got = katz_lm.unpack(katz_lm.pack(*many))
    assert len(got) == len(many) and all((a == b).all() and len(a) == len(b) for a, b in zip(got, many, strict=True))


def test_tuples_of_one_hash_are_told_apart():
    columns = [np.array([1, 1, 2, 2, 1]), np.array([5, 6, 5, 5, 5])]
    first, inverse = katz_lm._grouped(np.zeros(5, np.uint64), columns)
    assert len(first) == 3 and inverse[0] == inverse[4] != inverse[1] and inverse[2] == inverse[3]


def test_the_query_uses_the_whole_model(spark, tmp_path):
    from folio.llm.queries import op9_katz_lm

    r = random.Random(5)
    data = [(i, " ".join(r.choice("abcd") for _ in range(12))) for i in range(30)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    m = Plain([t for i, t in data if zlib.crc32(str(i).encode()) % 7 != 2])
    for row in op9_katz_lm(spark, str(tmp_path)).collect():
        assert math.isclose(row["score"], m.score(data[row["doc_id"]][1]), rel_tol=1e-6)


def test_histories_of_one_piece_are_not_asked_for(spark, tmp_path, monkeypatch):
    """Words that no other piece has ask nobody at the level above; what a held-out piece shares is asked for, and no table is written unless named."""
    monkeypatch.setattr(katz_lm, "PIECE_BYTES", 1)
    asked = []
    ask = katz_lm.Piece.ask

    def count(self, k, *more):
        for part, x in ask(self, k, *more):
            if part is not None:
                asked.append((k, len(katz_lm.unpack(x)[0])))
            yield part, x

    monkeypatch.setattr(katz_lm.Piece, "ask", count)
    order, parts = 3, 2
    data = [(1, "a b c own1 own2 own3", True), (2, "a b d own4 own5", True), (3, "a b c own1", False)]
    batch = katz_lm.pa.RecordBatch.from_arrays([katz_lm.pa.array(c) for c in zip(*data, strict=True)], ["doc_id", "text", "train"])
    rows = [r for b in katz_lm._read(parts, order)([batch]) for r in katz_lm._rows(katz_lm.pa.Table.from_batches([b]))]
    pieces, answers, level = [r for r in rows if r[1] == katz_lm.PIECE], [], [r for r in rows if r[1] == 1]
    totals = [r[5] for r in rows if r[1] == katz_lm.TOTALS]
    assert len(pieces) == 3
    for k in range(1, order + 1):
        if k > 1:
            level = []
            for p in pieces:
                right = katz_lm._table([a for a in answers if a[0] == p[0]])
                right = right.append_column("totals", katz_lm.pa.array([np.sum(totals, 0).tolist()] * len(right)))
                level += katz_lm._rows(katz_lm._asked(k, parts, order)(None, katz_lm._table([p]), right))
        for part in range(parts):
            out = katz_lm._rows(katz_lm._counted(k, order)(katz_lm._table([r for r in level if r[0] == part])))
            totals += [r[5] for r in out if r[1] == katz_lm.TOTALS]
            answers += [r for r in out if r[1] != katz_lm.TOTALS]
    # Of level 3 all share two histories of starts and "a b", the third text, held out, also "b c" and "c own1" with the first; of 7, 6 and 5 histories.
    assert sum(n for k, n in asked if k == 3) == 5 + 3 + 5
    m = Plain([t for _, t, train in data if train])
    for k in (2, 3):
        of = Counter(m.cc[k].values())
        at = 3 + (k - 2) * 6
        assert np.sum(totals, 0).tolist()[at : at + 6] == [of[r] for r in range(1, 7)]
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string").coalesce(1)
    base = tmp_path / "shared"
    monkeypatch.setattr(katz_lm, "scratch", lambda spark, name: f"file://{base}")
    got = {r["doc_id"]: r["score"] for r in katz_lm.scores(docs, F.col("doc_id") < 3).collect()}
    assert all(math.isclose(got[i], m.score(t), rel_tol=1e-9) for i, t, _ in data)
    assert sorted(x.name for x in base.iterdir() if x.is_dir()) == ["level=0"]


def test_the_query_keeps_its_tables(spark, tmp_path, monkeypatch):
    """All n-grams of all levels, those that one piece counted itself and those of parts."""
    from folio.llm import queries

    monkeypatch.setattr(queries, "scratch", lambda spark, name: f"file://{tmp_path}/tables")
    monkeypatch.setattr(katz_lm, "PIECE_BYTES", 200)
    data = rows(6)
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op9_katz_lm(spark, str(tmp_path)).count() == len(data)
    m = Plain([t for i, t in data if zlib.crc32(str(i).encode()) % 7 != 2])
    want = Counter({(k, c): n for k, cc in m.cc.items() for c, n in Counter(cc.values()).items()})
    got, own = Counter(), 0
    for part in katz_lm.stored(spark, f"file://{tmp_path}/tables").where("level > 1").collect():
        counts = katz_lm.unpack(part["data"])[-1]
        assert len(counts) == part["n_entries"]
        own += part["part"] == -1
        for c in counts.tolist():
            got[part["level"], c] += 1
    assert got == want and own > 0
