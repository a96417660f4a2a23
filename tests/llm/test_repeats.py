"""Recompression and the run-length index against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folio.llm import recompression, run_length_index
from folio.llm.common import Words


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, copy int, names string").repartition(3)


def plain_words(rows):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, ws in split:
        for a in range(len(ws) - 12):
            key = tuple(ws[a : a + 13])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, ws in split:
        gone = {j for a in range(len(ws) - 12) if least[tuple(ws[a : a + 13])] < i for j in range(a, a + 13)}
        out.append((i, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return out


def word_rows(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "c"] if seed % 2 else [f"w{i}" for i in range(300)]
    shared = [[r.choice(vocabulary) for _ in range(r.randint(5, 60))] for _ in range(8)] + [["x"] * 40, ["x"] * 7 + ["y"] * 30, ["p", "q"] * 20]
    rows = []
    for i in r.sample(range(100), 60):
        ws = []
        for _ in range(r.randint(0, 4)):
            ws += [r.choice(vocabulary) for _ in range(r.randint(0, 25))]
            if r.random() < 0.7:
                piece = r.choice(shared)
                a = r.randint(0, max(0, len(piece) - 10))
                ws += piece[a : a + r.randint(8, 60)]
        rows.append((i, r.choice([" ", "\n", "  "]).join(ws)))
    return [*rows, (200, None), (201, ""), rows[3], rows[4], (rows[5][0], rows[6][1]), (300, rows[7][1])]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_recompression(spark, seed):
    rows = word_rows(seed)
    out = recompression.remove_repeats(table(spark, rows))
    assert out.columns == ["doc_id", "n_words", "n_removed", "text"]
    assert Counter(map(tuple, out.collect())) == Counter(plain_words(rows))


def test_symbols_depend_on_the_window_alone():
    """Equal windows in different surroundings get equal names."""
    r = random.Random(9)
    seen = defaultdict(set)
    for _ in range(400):
        ws = [r.choice("ab") for _ in range(40)]
        raw = " ".join(ws).encode()
        starts, _, names = recompression.window_names(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        for s, n in zip(starts, names, strict=True):
            seen[tuple(ws[s : s + 13])].add(int(n))
    assert len(seen) > 4000 and all(len(v) == 1 for v in seen.values())


def plain_bytes(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(raw[a : a + 400] for _, raw in raws for a in range(len(raw) - 399))
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 399):
            if count[raw[a : a + 400]] > 1:
                gone[a : a + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def byte_rows(seed):
    r = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefghijklé日 "
    shared = ["".join(r.choice(letters) for _ in range(r.randint(300, 900))) for _ in range(5)] + ["xyz" * 300, "q" * 700, ("ab" * 80 + "cd" * 90) * 3]
    rows = []
    for i in range(40):
        text = ""
        for _ in range(r.randint(0, 3)):
            text += "".join(r.choice(letters) for _ in range(r.randint(0, 300)))
            if r.random() < 0.7:
                piece = r.choice(shared)
                a = r.randint(0, 100)
                text += piece[a : a + r.randint(350, 900)]
        rows.append((i, text))
    return [*rows, (200, None), (201, ""), rows[3], (rows[5][0], rows[6][1]), (300, rows[7][1])]


@pytest.mark.parametrize(("seed", "hot"), [(1, 2000), (2, 2000), (3, 0), (4, 0)])
def test_run_length_index(spark, seed, hot, monkeypatch):
    rows = byte_rows(seed)
    names = run_length_index.shared_names
    monkeypatch.setattr(run_length_index, "shared_names", lambda pairs, ties: names(pairs, ties, hot))
    out = run_length_index.remove_long_repeats(table(spark, rows))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    assert Counter((a, b, c, d, bytes(e)) for a, b, c, d, e in out.collect()) == Counter(plain_bytes(rows))


def edge_rows(seed):
    """Texts around a few middles: many share an anchor, and few the same 400 bytes around it."""
    r = random.Random(seed)
    letters = "abcdefghijklmnop"
    left, middle, right = ([("".join(r.choice(letters) for _ in range(n))) for _ in range(k)] for n, k in ((380, 9), (60, 12), (380, 9)))
    return [(i, r.choice(left) + r.choice(middle) + r.choice(right)) for i in range(150)]


@pytest.mark.parametrize("hot", [1, 2, 3])
def test_hot_anchors_of_several_texts_a_batch(spark, hot, monkeypatch):
    rows = edge_rows(hot)
    names = run_length_index.shared_names
    monkeypatch.setattr(run_length_index, "shared_names", lambda pairs, ties: names(pairs, ties, hot))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "12")
    try:
        out = run_length_index.remove_long_repeats(table(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter((a, b, c, d, bytes(e)) for a, b, c, d, e in out) == Counter(plain_bytes(rows))


def test_anchors_over_step_borders(monkeypatch):
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 9000).astype(np.uint8)
    offsets = np.array([0, 100, 100, 4000, 9000])
    whole = run_length_index.anchors(data, offsets)
    monkeypatch.setattr(run_length_index, "STEP", 1000)
    parts = run_length_index.anchors(data, offsets)
    spread = [{s: (p, n) for p, n, a, b in zip(*(x.tolist() for x in y), strict=True) for s in range(a, b + 1)} for y in (whole, parts)]
    assert spread[0] == spread[1] and len(spread[0]) == 3900 - 399 + 5000 - 399


def test_empty_tables(spark):
    assert recompression.remove_repeats(table(spark, [])).count() == 0
    assert run_length_index.remove_long_repeats(table(spark, [])).count() == 0


def test_equal_rows_are_kept_once(monkeypatch):
    """Many copies of one context, in batches of any size, give what all of them together give."""
    r = random.Random(5)
    contexts = [(r.randbytes(50), r.randbytes(400)) for _ in range(4)]
    contexts.append((contexts[0][0], contexts[0][1][:390] + b"0123456789"))
    rows = sorted(((k % 2, i, 0, 1000, 950, 1000, False, *contexts[k]) for i in range(200) for k in [r.randrange(5)]), key=lambda x: (x[0], x[8], x[7]))
    names = ["key", "doc_id", "copy", "place", "low", "high", "full", "before", "after"]
    whole = sorted(run_length_index._index(rows))
    monkeypatch.setattr(run_length_index, "EQUAL_ROWS", 7)
    batches = [run_length_index.pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows[a : a + 30]]) for a in range(0, len(rows), 30)]
    got = [tuple(x.values()) for out in run_length_index._intervals(batches) for x in out.to_pylist()]
    assert sorted(got) == whole and len(whole) > 150
