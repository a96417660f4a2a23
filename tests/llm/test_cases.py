"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folio.llm import binary_records, byte_bpe, decontaminate, katz_lm, license_scan, line_templates, prob_minhash, quality_cascade, recompression, run_length_index

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")
LEAST = -(1 << 63)
#: Names that operators use for columns of their own.
CLASH = ("key", "row", "copy", "drop", "n", "node", "label", "band", "hash", "train", "kind", "part", "piece", "ids", "n_words", "n_tokens", "start", "place", "name", "license", "digest", "c", "f", "text_digest")
LONG = " ".join(f"w{i % 977}x{i % 1009}" for i in range(60_000))
ROWS = [(1, "a b c\nAll rights reserved."), (1, "a b c\nAll rights reserved."), (1, "another text of this id"), (2, ""), (3, None), (None, "no id here at all"), (None, None), (None, "no id here at all"), (4, "same " * 3000), (5, LONG), (6, LONG), (7, "\n \t\n")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, *[None if j % 2 else "x"] * len(CLASH)) for j, (i, t) in enumerate(rows)], ", ".join(["doc_id long", "text string", *(f"{c} string" for c in CLASH)])).repartition(3)


def records(docs):
    from folio.llm.common import scratch

    folder = scratch(docs.sparkSession, "cases")
    binary_records.write_records(docs, folder, WORD, 2, 49_408, 3)
    return binary_records.read_records(docs.sparkSession, folder)


OPERATORS = {
    "op1": license_scan.license_scan,
    "op2": lambda d: byte_bpe.decode(byte_bpe.encode(d, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN),
    "op3": records,
    "op4": line_templates.drop_lines,
    "op5": quality_cascade.quality,
    "op7": recompression.remove_repeats,
    "op8": run_length_index.remove_long_repeats,
    "op9": lambda d: katz_lm.scores(d, F.lit(True)),
    "op10": prob_minhash.near_duplicates,
}
#: Operators whose results keep a null id; for the others it is the smallest long.
KEEPS_NULL = ("op1", "op2", "op4", "op5")


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    out = OPERATORS[name](table(spark, ROWS))
    ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert ids == Counter(i if i is not None or name in KEEPS_NULL else LEAST for i, _ in ROWS)
    none = OPERATORS[name](table(spark, ROWS).limit(0))
    assert none.count() == 0 and none.columns == out.columns


def test_results_of_the_odd_rows(spark):
    docs = table(spark, ROWS)
    got = [(r["doc_id"], r["n_notices"], r["text_digest"] is None) for r in OPERATORS["op1"](docs).collect()]
    assert Counter(got) == Counter([(1, 2, False)] * 3 + [(2, 0, True), (3, 0, True), (7, 0, True), (None, 0, True), (4, 0, False), (5, 0, False), (6, 0, False)] + [(None, 0, False)] * 2)
    got = Counter((r["doc_id"], hashlib.sha256(bytes(r["decoded"])).hexdigest()) for r in OPERATORS["op2"](docs).collect())
    assert got == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    t = Tokenizer.from_file(WORD)
    want, at = [], 0
    for i, x in sorted(((LEAST if i is None else i, x or "") for i, x in ROWS)):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids)))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], len(r["ids"])) for r in OPERATORS["op3"](docs).collect()) == want
    classes = Counter((r["doc_id"], r["class_id"]) for r in OPERATORS["op10"](docs).collect())
    assert classes == Counter([(1, 1)] * 3 + [(2, 2), (3, 3), (7, 7), (4, 4), (5, 5), (6, 5)] + [(LEAST, LEAST)] * 3)
    gone = {r["doc_id"]: r["n_removed"] for r in OPERATORS["op7"](docs).where("doc_id in (5, 6)").collect()}
    assert gone == {5: 0, 6: 60_000}
    gone = {r["doc_id"]: r["n_removed"] for r in OPERATORS["op8"](docs).where("doc_id in (4, 5, 6)").collect()}
    assert gone == {4: 15_000, 5: len(LONG), 6: len(LONG)}
    kept = {r["doc_id"]: r["kept"] for r in OPERATORS["op5"](docs).where("doc_id > 1").collect()}
    assert kept == {2: False, 3: False, 4: False, 5: True, 6: True, 7: False}


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(30))
    rows = [*ROWS, (None, f"x {item}"), (8, item), (8, item), (9, LONG + " " + item)]
    benchmark = spark.createDataFrame([(1, item, "x"), (None, "no id here at all", "x"), (2, None, None), (3, "", "x"), (4, "...", "x")], "item_id long, text string, key string")
    found = Counter((r["doc_id"], r["item_id"], r["start_word"]) for r in decontaminate.contaminations(table(spark, rows), benchmark).collect())
    assert found == Counter({(None, 1, 1): 1, (8, 1, 0): 2, (9, 1, 60_000): 1})
    left = decontaminate.decontaminated(table(spark, rows), benchmark)
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, _ in ROWS) and left.columns == table(spark, rows).columns
    assert decontaminate.contaminations(table(spark, rows).limit(0), benchmark).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, stage):
    """What each stage of the pipeline leaves of the odd rows."""
    name, function = stage
    left = {
        "quality rules": [5, 6],
        "line dedup": [i for i, _ in ROWS],
        "near dedup": [1, 1, 1, 2, 3, None, None, None, 4, 5, 7],
        "decontamination": [i for i, _ in ROWS],
        "byte-level BPE": [i for i, _ in ROWS],
    }[name]
    docs = table(spark, ROWS)
    out = function(spark, docs, "/root/testdata/sf0.001")
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter(left)
    assert out.columns == (["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if name == "byte-level BPE" else docs.columns)
    assert function(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
