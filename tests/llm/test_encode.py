"""License scan, byte-level BPE, binary records and quality rules against plain versions."""

import hashlib
import os
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import binary_records, byte_bpe, crc32c, license_scan, quality_cascade

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")


ODD = ["", None, "a", " ", "\n", "  \n\n x", "l'été 12345 !!!", "é" * 50, "word " * 40, "'re 're'll", " " * 60, "a" * 90, "x 　y", "日本語テキスト", "🙂🙂 ok", "áb ́c", "İI ǅ Σς", "\r\n\t tab"]


def fuzz(n, seed=1):
    r = random.Random(seed)
    parts = ["word", " ", "  ", "\n", "'re", "'", "12", "é", "!?", "\t", "日", " the", " ", "🙂"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_bpe_equals_the_library_at_any_chunk_size(spark):
    core = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    texts = ODD + fuzz(60)
    rows = list(enumerate(texts)) + [(0, ""), (6, texts[6]), (6, texts[6])]
    for chunk, overlap in ((7, 5), (16, 12), (40, 20), (32768, 1024)):
        got = byte_bpe.decode(byte_bpe.encode(table(spark, rows), RANKS, public_tokenizers.PATTERN, chunk, overlap), RANKS, public_tokenizers.PATTERN).collect()
        want = Counter((i, tuple(core.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
        assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want


def test_bpe_digests_and_empty_table(spark):
    core = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    got = byte_bpe.digests(byte_bpe.encode(table(spark, [(3, "hello  world")]), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()[0]
    ids = core.encode_ordinary("hello  world")
    assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4")).hexdigest())
    assert got["decoded_sha256"] == hashlib.sha256(b"hello  world").hexdigest()
    assert byte_bpe.encode(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    assert isinstance(core, tiktoken.Encoding)


def test_records_round_trip(spark, tmp_path):
    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    texts = ODD + fuzz(40, 2) + ["<|endoftext|> x", "Don't THE Straße, ÀÉÎ÷× e\u0301a ª µ {x}=1;", "\x01\x02 a\x7fb"]
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    rows = [(i * 3, x) for i, x in zip(ids, texts, strict=True)]
    folder = f"file://{tmp_path}/r"
    binary_records.write_records(table(spark, rows), folder, WORD, 2, 49_408, 5)
    got = {r["doc_id"]: r for r in binary_records.read_records(spark, folder).collect()}
    start = 0
    for i, x in sorted(rows, key=lambda r: r[0]):
        want = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (list(got[i]["ids"]), got[i]["start"]) == (want, start), x
        start += len(want)
    index = binary_records.read_index(spark, folder)
    some = binary_records.read_records(spark, folder, index.where("doc_id % 2 = 0"))
    assert {r["doc_id"] for r in some.collect()} == {i for i, _ in rows if i % 2 == 0}


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ 0x82F63B78 * (crc & 1)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    r = random.Random(7)
    parts = [b"123456789", b"", b"\0" * 70, *(r.randbytes(n) for n in (1, 7, 63, 64, 65, 128, 1000, 5000)), b""]
    ends = np.cumsum([len(x) for x in parts])
    got = crc32c.checksums(np.frombuffer(b"".join(parts), np.uint8), np.append(0, ends[:-1]), ends)
    assert got[0] == 0xE3069283 and got.tolist() == [plain_crc32c(x) for x in parts]


def test_records_detect_damage():
    both = binary_records.frames([7, -1], [np.array([1, 2, 300], np.uint32), np.zeros(0, np.uint32)], 2)
    good = b"".join(both)
    got = [(d, x.tolist(), a, b) for d, x, a, b in binary_records.unframe(good, None, 2)]
    assert got == [(7, [1, 2, 300], 0, len(both[0])), (-1, [], len(both[0]), len(good))]
    assert binary_records.unframe(good, [len(both[0])], 2)[0][0] == -1 and binary_records.unframe(b"", None, 2) == []
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            binary_records.unframe(bytes(bad), None, 2)


def test_files_in_order_of_their_numbers(spark, tmp_path, monkeypatch):
    """A name of six digits sorts before one of five as text."""
    monkeypatch.setattr(binary_records, "FILES", 2)
    rows = [(f"part-{n}-x.txt", n, 0, 1, 0, n % 7 + 1, 2) for n in (99998, 99999, 100000, 100001, 3)]
    spark.createDataFrame(rows, "file string, doc_id long, offset long, length long, place long, n_tokens long, width int").write.parquet(f"{tmp_path}/index")
    got = {r["doc_id"]: r["start"] for r in binary_records.read_index(spark, str(tmp_path)).collect()}
    start = 0
    for n in sorted(got):
        assert got[n] == start
        start += n % 7 + 1


def test_words_of_one_hash_are_told_apart(monkeypatch):
    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    real = binary_records.Words

    def few(*args):
        words = real(*args)
        words.hash = words.hash % np.uint64(3)
        return words

    monkeypatch.setattr(binary_records, "Words", few)
    texts = ["one two three", "four five", "", "six one"]
    data = [x.encode() for x in texts]
    ids, stops = binary_records.text_ids(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(x) for x in data])), WORD)
    assert [ids[a:b].tolist() for a, b in zip(stops, stops[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_records_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    binary_records.write_records(table(spark, []), folder, WORD, 2, 49_408, 3)
    assert binary_records.read_records(spark, folder).count() == 0


def scanned(spark, rows, **options):
    return [(r["doc_id"], r["license"], r["n_notices"], r["notices"], r["text_digest"] is None) for r in license_scan.license_scan(table(spark, rows), **options).collect()]


def wrapped(text, width=70):
    return textwrap.fill(text, width)


def test_license_scan(spark):
    mit = license_scan.KNOWN[0][1]
    rows = [(1, mit), (2, mit.upper().replace(",", " ; ").replace("HOLDERS\n", "SOMEBODY 2020\nCopyright 2021 Other\n")), (3, "x " + mit), (4, "Text.\nReleased under the MIT Licence!\nAll rights reserved.\n"), (5, None), (6, ""), (7, "..."), (4, "other")]
    got = sorted(x for x in scanned(spark, rows) if x[0] != 4)
    assert [x[:2] + x[4:] for x in got] == [(1, "MIT", False), (2, "MIT", False), (3, None, False), (5, None, True), (6, None, True), (7, None, True)]
    assert scanned(spark, rows[3:4]) == [(4, None, 2, "LicenseRef-all-rights-reserved,MIT", False)]
    assert sorted(map(str, scanned(spark, rows, broadcast_rows=0))) == sorted(map(str, scanned(spark, rows)))
    assert license_scan.license_scan(table(spark, [])).count() == 0
    nulls = sorted(scanned(spark, [(None, "All rights reserved."), (None, "x"), (8, "All rights reserved.")]), key=str)
    assert [x[2] for x in nulls] == [1, 1, 1]


def test_licenses_in_their_usual_layouts(spark):
    """Wrapped anywhere, with titles, statements of copyright, comment marks and bullets, and spelt otherwise."""
    known = dict(license_scan.KNOWN[::-1])
    bodies = {n: next(b for k, b in license_scan.KNOWN if k == n and len(b) > 300) for n in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause")}
    assert set(bodies) <= set(known)
    rows, want = [], []
    for name, body in bodies.items():
        body = body.removeprefix("MIT License\nCopyright (c) holders\n")
        for width in range(30, 90, 6):
            for title in ("", "The MIT License (MIT)\n\n", "ISC License\n", "# BSD 3-Clause License\n"):
                for statement in ("", "Copyright (c) 2020, Some Body <a@b.example>\n\n", "# Copyright 2019 The Authors\n", "© A\nCOPYRIGHT (C) 2001 B\n", "Copyright Foo Inc.\n"):
                    rows.append((len(rows), title + statement + wrapped(body, width)))
                    want.append(name)
    body = bodies["BSD-3-Clause"].replace("permitted provided that the following conditions are met:  ", "permitted provided that the following conditions are met:\n\n* ").replace("license", "licence")
    rows.append((len(rows), body))
    want.append("BSD-3-Clause")
    rows.append((len(rows), bodies["ISC"].replace("with or without fee", "with fee")))
    want.append(None)
    got = dict((x[0], x[1]) for x in scanned(spark, rows))
    assert [got[i] for i, _ in rows] == want


def test_neighbouring_spellings_and_digests(spark):
    text = spark.createDataFrame([("licence licence licence, sub-licence per cent",), ("license license license sublicense percent",)], "t string")
    assert text.select(license_scan.digest(F.col("t"))).distinct().count() == 1
    folder = "/usr/share/common-licenses"
    files = [(i, n, open(f"{folder}/{n}", encoding="utf-8", errors="replace").read()) for i, n in enumerate(("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0")) if os.path.exists(f"{folder}/{n}")]
    got = {x[0]: x[1] for x in scanned(spark, [(i, t) for i, _, t in files])}
    assert [got[i] for i, _, _ in files] == [{"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0"}.get(n, n) for _, n, _ in files]


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 20 or 100 * len(hit) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_quality_figures(spark):
    r = random.Random(5)
    few = ["a b c d e f g h", "one two three", "x\n\nx\n", "\nx\nx", "é# $5", "\x0b\x0c"]
    texts = ODD + fuzz(40) + [" ".join(r.choice("abc") for _ in range(50)) for _ in range(10)] + ["\n".join(r.choice(few) for _ in range(9)) for _ in range(30)]
    rows = list(enumerate(texts)) + [(1, "again")]
    got = quality_cascade.quality(table(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((x["doc_id"], *(x[n] for n in names)) for x in got) == Counter((i, *plain_quality(t)) for i, t in rows)
    assert all(not x["kept"] for x in got if x["base_failed"])
    kept = quality_cascade.keep_good(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "n_tokens"]
    assert Counter(x["doc_id"] for x in kept.collect()) == Counter(x["doc_id"] for x in got if x["kept"])


def test_quality_order_does_not_change_the_verdict(spark):
    texts = [f"{w} " * 30 + " ".join(f"w{i}{j}" for j in range(90)) for i, w in enumerate(["A!", "b#", "CC", "d", "ee"])]
    docs = table(spark, list(enumerate(texts)))
    orders = [quality_cascade.RULES, quality_cascade.RULES[::-1]]
    assert len({tuple(sorted((x["doc_id"], x["kept"]) for x in quality_cascade.quality(docs, rules).collect())) for rules in orders}) == 1
    costs = quality_cascade.estimate(docs)
    assert [r.name for r in quality_cascade.order(docs)] and all(cost > 0 for _, cost, _ in costs)
