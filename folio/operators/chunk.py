"""Documents to addressable chunks of text: one row per block that has text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import document_id, falsy, normalize_text, section_key


def joined(items: Column, separator: str) -> Column:
    return F.coalesce(F.array_join(items, separator, ""), F.lit(""))


def table_lines(block: Column) -> Column:
    """Header line and row lines of a table."""
    empty = F.array().cast("array<string>")
    head = F.when(F.size(F.coalesce(block["headers"], empty)) > 0, F.array(joined(block["headers"], " | "))).otherwise(empty)
    return F.concat(head, F.coalesce(F.transform(block["rows"], lambda r: joined(r, " | ")), empty))


def definition_lines(block: Column) -> Column:
    return F.transform(block["definitions"], lambda d: F.concat(F.coalesce(d["term"], F.lit("")), F.lit(": "), F.coalesce(d["definition"], F.lit(""))))


def block_text(block: Column) -> Column:
    """A block's text by its type, white space normalised."""
    kind = block["type"]
    text = (
        F.when(kind == "list", joined(block["items"], "\n"))
        .when(kind == "definitionList", joined(definition_lines(block), "\n"))
        .when(kind == "table", joined(table_lines(block), "\n"))
        .when(kind == "algorithm", joined(F.transform(block["steps"], lambda s: F.concat(s["step_id"], F.lit(". "), s["text"])), "\n"))
        .when(kind == "grammar", joined(F.transform(block["productions"], lambda p: F.concat(p["lhs"], F.lit(" ::= "), p["rhs"])), "\n"))
        .otherwise(block["text"])
    )
    return normalize_text(text)


def chunks(docs: DataFrame) -> DataFrame:
    """One row per non-empty block, with ids, provenance and text.  No shuffle.

    ``doc_seq`` (if the documents have it) and the ordinals give the order.
    """
    order = F.col("doc_seq") if "doc_seq" in docs.columns else F.lit(0).cast("long")
    family = F.coalesce(falsy(F.col("family")), F.lit("generic"))
    # Outer generators: from an inner one a filter on the array would be inferred and pushed down, and extraction run twice.
    # What a document has once is worked out before its blocks multiply it.
    docs = docs.select("*", order.alias("doc_order"), family.alias("own_family"), document_id(F.col("url")).alias("doc_id"))
    flat = docs.select("*", F.explode_outer("sections").alias("section"))
    full = F.filter(F.transform("section.blocks", lambda b: F.struct(b.alias("b"), block_text(b).alias("text"))), lambda x: x["text"] != "")
    flat = flat.select("*", F.explode_outer(full).alias("x")).where("x is not null").select("*", F.col("x.b").alias("block"), F.col("x.text").alias("flat_text"))
    name = F.coalesce(falsy(F.col("block.id")), F.concat(F.lit("block-"), (F.col("block.ordinal") + 1).cast("string")))
    anchor = F.coalesce(falsy(F.col("block.source.fragment")), falsy(F.col("section.id")))
    out = flat.select(
        "doc_order", F.col("section.ordinal").alias("section_ordinal"), F.col("block.ordinal").alias("block_ordinal"),
        "doc_id", section_key(F.col("section.id"), F.col("section.ordinal")).alias("section_key"), name.alias("block_key"),
        "url", F.concat(F.lit("#"), anchor).alias("fragment"), F.col("own_family").alias("family"), F.coalesce(falsy(F.col("authority")), F.lit("informative")).alias("authority"),
        falsy(F.col("section.id")).alias("section_id"), falsy(F.col("block.id")).alias("block_id"), F.col("block.type").alias("block_type"),
        falsy(F.col("section.heading")).alias("heading"), F.nullif(F.col("section.level"), F.lit(0)).alias("level"), F.col("flat_text").alias("text"),
        F.coalesce("block.source", "section.source").alias("source"), F.coalesce("block.links", F.expr("cast(array() as array<struct<text:string,href:string,resolved_id:string>>)")).alias("links"),
        "snapshot_id", "extracted_at", F.col("block.normativity").alias("normativity"), *[c for c in ("file",) if c in docs.columns],
    )
    key = F.concat_ws("--", "doc_id", "section_key", "block_key")
    return out.withColumns({"chunk_id": F.concat_ws("::", "doc_id", "section_key", "block_key"), "path": F.concat(F.col("family"), F.lit("/"), key, F.lit(".json"))})


ORDER = ("doc_order", "section_ordinal", "block_ordinal")


def chunk_index(chunked: DataFrame, *more: Column) -> DataFrame:
    """The list of chunks: one row per chunk with the hash of its text, and ``more`` columns."""
    return chunked.select(
        *ORDER, "chunk_id", "doc_id", "family", "heading", "section_id", "block_id", "block_type", "url", "fragment", "path", F.sha2("text", 256).alias("text_hash"), *more,
    )
