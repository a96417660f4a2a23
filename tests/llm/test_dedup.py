"""Line templates, decontamination, near duplicates and the pipeline against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from folio.llm import byte_bpe, decontaminate, line_templates, prob_minhash, quality_cascade
from folio.llm.components import components

SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, key string, row string")


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def bag(ws):
    if 0 < len(ws) < 5:
        return Counter([tuple(ws)])
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))


def weighted(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def plain_classes(rows):
    bags = [(i, bag(words(t))) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, (i, a) in enumerate(bags):
        for j, b in bags[:n]:
            if a and b and 5 * sum((a & b).values()) >= 4 * sum((a | b).values()):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i, _ in rows}


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(3, 200))] for _ in range(n)]
    rows = []
    for i, ws in enumerate(base):
        rows.append(" ".join(ws))
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            copy = list(ws)
            for _ in range(r.randint(0, 1 + len(ws) // 40)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(r.choice([" ", ", ", "\n"]).join(copy).capitalize())
    r.shuffle(rows)
    return list(enumerate([*rows, "", None, "...", "", rows[3]]))


@pytest.mark.parametrize("block", [250_000, 300])
def test_near_duplicates(spark, block):
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_duplicates(table(spark, rows), block).collect()}
    assert got == plain_classes(rows)


def test_near_duplicates_odd_tables(spark):
    assert prob_minhash.near_duplicates(table(spark, [])).count() == 0
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (9, "A, b c d e f!"), (None, None)]
    got = sorted((r["doc_id"], r["class_id"]) for r in prob_minhash.near_duplicates(table(spark, rows)).collect())
    assert got == [(-(1 << 63), -(1 << 63)), (4, 4), (4, 4), (9, 4)]
    clash = table(spark, rows).withColumnRenamed("key", "copy_id")
    assert prob_minhash.without_near_duplicates(clash).columns == ["doc_id", "text", "copy_id", "row"]
    left = prob_minhash.without_near_duplicates(table(spark, rows))
    assert left.columns == ["doc_id", "text", "key", "row"] and Counter(r["doc_id"] for r in left.collect()) == {4: 2, None: 1}


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id with different texts are different texts, and classes meet in all of them."""
    r = random.Random(12)
    a, b, c = (" ".join(r.choice("abcdefghijklmnop") + str(r.randrange(99)) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, b + " tail"), (3, a + " end"), (None, c), (None, c + " more"), (None, "x")]
    got = sorted((x["doc_id"], x["class_id"]) for x in prob_minhash.near_duplicates(table(spark, rows)).collect())
    least = -(1 << 63)
    assert got == [(least, least), (least, least), (least, least), (1, 1), (1, 1), (2, 1), (3, 1)]
    left = [(x["doc_id"], x["text"]) for x in prob_minhash.without_near_duplicates(table(spark, rows)).collect()]
    assert sorted(t for i, t in left if i == 1) == sorted([a, b]) and len(left) == 4
    assert sum(i is None for i, _ in left) == 2 and (None, "x") in left


def test_links_join_what_any_similar_pair_joins():
    """Texts in a chain, of which the ends aren't similar, and classes known before."""
    def of(low, high):
        return np.arange(low, high, dtype=np.uint64), np.ones(high - low, np.int64), high - low

    sets = [of(0, 100), of(8, 108), of(16, 116), of(500, 600), of(900, 1000)]
    joined = {frozenset(x) for x in prob_minhash.links([1, 2, 3, 4, 5], sets, [1, 2, 3, 4, 5])}
    assert joined == {frozenset((1, 2)), frozenset((2, 3))}
    assert prob_minhash.links([1, 2, 3], sets[:3], [1, 1, 1]) == []
    assert {frozenset(x) for x in prob_minhash.links([1, 2, 3], sets[:3], [1, 2, 3], [0, 0, 1])} == {frozenset((2, 3))}


def test_signatures_estimate_the_probability_jaccard():
    r = np.random.default_rng(2)
    x = r.integers(0, 2**63, 60).astype(np.uint64)
    w = r.integers(1, 5, 60)
    hits, exact = [], None
    for n in range(60):
        names = prob_minhash.mix(x + np.uint64(n * 7919))
        a = prob_minhash.signatures(np.zeros(50, int), names[:50], w[:50], 1)
        b = prob_minhash.signatures(np.zeros(50, int), names[10:], w[10:], 1)
        hits.append((a == b).mean())
    p, q = np.where(np.arange(60) < 50, w, 0) / w[:50].sum(), np.where(np.arange(60) >= 10, w, 0) / w[10:].sum()
    both = (p > 0) & (q > 0)
    exact = sum(1 / np.maximum(p / p[d], q / q[d]).sum() for d in np.flatnonzero(both))
    assert abs(np.mean(hits) - exact) < 0.02


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 90)] + [(100, 100)] + [(200, 200 + i) for i in range(1, 40)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label.get(a, a), label.get(b, b))
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


def plain_matches(text, items):
    out, ws = {}, words(text)
    for item, body in items:
        ib = words(body)
        if not ib:
            continue
        scores = [(weighted(bag(ws[s : s + len(ib)]), bag(ib)), -s) for s in range(len(ws) - len(ib) + 1)]
        if scores and max(scores)[0] >= 0.8:
            out[item] = (round(max(scores)[0], 9), -max(scores)[1], len(ib))
    return out


def test_contaminations(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 8, 20, 40, 60])))) for i in range(40)] + [(90, ""), (91, None), (92, "a a a a a a a a")]
    texts = ["", None, "a " * 30]
    for _ in range(60):
        ws = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        for _ in range(r.randint(0, 2)):
            piece = words(r.choice(items)[1])
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                if piece:
                    piece[r.randrange(len(piece))] = r.choice(vocabulary)
            at = r.randint(0, len(ws))
            ws[at:at] = piece
        texts.append(", ".join(ws).upper())
    rows = list(enumerate(texts))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, item): v for i, t in rows for item, v in plain_matches(t, items).items()}
    for block in (2000, 7):
        got = {(x["doc_id"], x["item_id"]): (round(x["similarity"], 9), x["start_word"], x["n_words"]) for x in decontaminate.contaminations(table(spark, rows), benchmark, block).collect()}
        assert got == want
    clean = decontaminate.decontaminated(table(spark, rows), benchmark)
    assert clean.columns == ["doc_id", "text", "key", "row"]
    assert sorted(x["doc_id"] for x in clean.collect()) == sorted({i for i, _ in rows} - {i for i, _ in want})
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminations(table(spark, rows), nothing).count() == 0
    assert decontaminate.decontaminated(table(spark, []), benchmark).count() == 0


def plain_lines(rows):
    parsed, pairs = {}, set()
    for n, (i, text) in enumerate(rows):
        for p, line in enumerate((text or "").split("\n")):
            ts = tuple("<*>" if re.search("[0-9]", t) else t for t in re.split(r"[ \t\x0b\f\r]+", line) if t)
            if ts:
                parsed[n, p] = ts
                pairs.add((ts, i))
    leaf = lambda ts: (len(ts), ts[:3])
    lines = Counter(leaf(ts) for ts, _ in pairs)
    at = Counter((leaf(ts), k, t) for ts, _ in pairs for k, t in enumerate(ts) if k >= 3 and t != "<*>")

    def general(ts):
        keep = [at[leaf(ts), k, t] >= 10 and 10 * at[leaf(ts), k, t] >= lines[leaf(ts)] for k, t in enumerate(ts) if k >= 3]
        return (leaf(ts), tuple(t if k else None for t, k in zip(ts[3:], keep, strict=True))) if keep and 2 * sum(keep) >= len(keep) else None

    docs = defaultdict(set)
    for ts, i in pairs:
        docs[ts].add(i)
        if general(ts):
            docs[general(ts)].add(i)
    out = []
    for n, (i, text) in enumerate(rows):
        keep = []
        for p, line in enumerate((text or "").split("\n")):
            ts = parsed.get((n, p), ())
            ids = docs[general(ts)] if ts and general(ts) and len(docs[general(ts)]) >= 10 else docs[ts] if ts and 2 * sum(t != "<*>" for t in ts) >= len(ts) else ()
            keep.append(len(ids) < 10 or i == min(ids))
        lines_ = (text or "").split("\n")
        out.append((i, None if text is None else "\n".join(x for x, k in zip(lines_, keep, strict=True) if k), 0 if text is None else len(lines_), keep.count(False)))
    return out


def line_rows():
    r = random.Random(8)
    rows = []
    for i in range(80):
        lines = [f"user {r.choice(['ann', 'bob', 'c' + str(i)])} logged in from {r.random()} today" if r.random() < 0.4 else " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 7))]
        if r.random() < 0.5:
            lines.insert(r.randint(0, len(lines)), "All rights reserved.")
        if r.random() < 0.3:
            lines.append("  Page   12 of \t 40 ")
        rows.append((i, "\n".join(lines)))
    return [*rows, (500, None), (501, ""), (3, rows[3][1]), (502, "\n\nAll rights reserved.\n")]


def test_line_templates(spark):
    rows = line_rows()
    out = line_templates.drop_lines(table(spark, rows))
    assert out.columns == ["doc_id", "text", "key", "row", "n_lines", "n_dropped"]
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect())
    want = plain_lines(rows)
    assert got == Counter(want) and sum(x[3] for x in want) > 50
    left = line_templates.without_boilerplate(table(spark, rows))
    assert left.columns == ["doc_id", "text", "key", "row"]
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, t, _, n in want if not n or t.strip())
    assert line_templates.drop_lines(table(spark, [])).count() == 0


def test_lines_that_share_only_their_path_stay(spark):
    """Many documents whose short lines have three leading words in common and nothing else, beside a real template and short lines."""
    rows = [(i, f"a b c x{chr(97 + i % 26)}{chr(97 + i // 26)} y{'z' * i} w{'v' * i}\nuser {'n' * (i + 1)} has logged in from home\nOK.\n{i}") for i in range(30)]
    rows += [(100 + i, f"the cat is {'q' * (i + 1)} on mat{'t' * i}") for i in range(200)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_templates.drop_lines(table(spark, rows)).collect()}
    assert all(got[i] == ("\n".join(t.split("\n")[j] for j in (0, 1, 3)) if i else t, int(i > 0)) for i, t in rows if i < 100)
    assert all(got[i] == (t, 0) for i, t in rows if i >= 100)
    kept = line_templates.drop_lines(table(spark, rows), min_tokens=2)
    assert kept.where("n_dropped > 0").count() == 0


def test_pipeline_equals_plain_stages(spark):
    from .test_encode import plain_quality

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs]
    verdict = {r["doc_id"]: r["kept"] for r in quality_cascade.quality(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert not any(verdict[i] and plain_quality(t)[-1] for i, t in rows)
    rows = [(i, t) for i, t, _, n in plain_lines([(i, t) for i, t in rows if verdict[i]]) if not n or t.strip()]
    label = plain_classes(rows)
    rows = [(i, t) for i, t in rows if label[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not plain_matches(t, items)]
    core = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {i: (hashlib.sha256(np.array(core.encode_ordinary(t), "<u4")).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    got = {r["doc_id"]: (r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "byte-level BPE"]
