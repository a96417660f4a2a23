"""Five operators in a row over the table of documents.

Each stage takes (spark, docs, sf_dir); ``run`` writes what a stage returns as
Parquet in the shared folder and reads it back for the next.

Every stage takes an empty table (and gives one), null ids (rows without one are
kept apart from others only by their texts), repeated rows, texts of any length,
whole, and columns of any other names, which stay until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folio.llm import byte_bpe, decontaminate, line_templates, prob_minhash, quality_cascade
from folio.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a rule rejects go, null and empty texts among them; figures at a bound pass."""
    return quality_cascade.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all but the least id, and documents of which no line is left; null and empty texts stay."""
    return line_templates.without_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class stays, with all its equal rows; texts without words are no one's copies."""
    return prob_minhash.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; items without id or text are none, and null and empty texts hold none."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document, null ids as they are: its token ids, counted and digested; null and empty texts have none."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near-duplicate classes and BPE are beyond SQL; tests/llm compares with plain versions.
ORACLE_SQL = None
