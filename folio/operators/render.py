"""Documents as Markdown, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import JAVA_WHITE, falsy, iso
from folio.operators.chunk import definition_lines, joined

EMPTY = "array<string>"


def _array(*lines: Column) -> Column:
    return F.array(*lines).cast(EMPTY)


def table_markdown(b: Column) -> Column:
    """Pipes around cells; cells are not escaped."""
    row = lambda cells: F.concat(F.lit("| "), joined(cells, " | "), F.lit(" |"))
    head = F.when(F.size(F.coalesce(b["headers"], _array())) > 0, F.array(row(b["headers"]), row(F.transform(b["headers"], lambda _: F.lit("---"))))).otherwise(_array())
    return F.concat(head, F.coalesce(F.transform(b["rows"], row), _array()))


def block_markdown(b: Column) -> Column:
    """The lines of one block."""
    kind = b["type"]
    title = F.when(falsy(b["title"]).isNotNull(), F.concat(F.lit("Algorithm: "), b["title"])).otherwise("Algorithm:")
    return (
        F.when(kind == "code", F.array(F.lit("```"), b["text"], F.lit("```")))
        .when(kind == "list", F.transform(b["items"], lambda x: F.concat(F.when(b["ordered"], F.lit("1. ")).otherwise("- "), x)))
        .when(kind == "algorithm", F.concat(F.array(title), F.transform(b["steps"], lambda s: F.concat(s["step_id"], F.lit(". "), s["text"]))))
        .when(kind == "grammar", F.transform(b["productions"], lambda p: F.concat(p["lhs"], F.lit(" ::= "), p["rhs"])))
        .when(kind == "note", F.array(F.concat(F.lit("> "), b["text"])))
        .when(kind == "definitionList", F.transform(definition_lines(b), lambda x: F.concat(F.lit("- "), x)))
        .when(kind == "table", table_markdown(b))
        .otherwise(F.array(F.coalesce(b["text"], F.lit(""))))
    )


def section_markdown(s: Column) -> Column:
    level = F.least(F.greatest(F.coalesce(F.nullif(s["level"], F.lit(0)), F.lit(2)), F.lit(2)), F.lit(6))
    heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.coalesce(falsy(s["heading"]), F.lit("Untitled")))
    name = F.when(falsy(s["id"]).isNotNull(), F.array(F.lit(""), F.concat(F.lit("ID: "), s["id"]))).otherwise(_array())
    body = F.flatten(F.transform(s["blocks"], lambda b: F.concat(block_markdown(b), F.array(F.lit("")))))
    return F.concat(F.array(heading), name, F.array(F.lit("")), body)


def markdown(docs: DataFrame, trimmed: bool = True) -> DataFrame:
    """``url``, ``path`` (if the documents have one) and ``markdown``, which ends in one line end unless ``trimmed`` is false: then its last lines stay as they are."""
    optional = lambda label, c: F.when(falsy(F.col(c)).isNotNull(), F.array(F.concat(F.lit(f"{label}: "), F.col(c)))).otherwise(_array())
    lines = F.concat(
        F.array(F.concat(F.lit("# "), F.col("title")), F.lit(""), F.concat(F.lit("URL: "), F.col("url")), F.concat(F.lit("Family: "), F.col("family"))),
        optional("Authority", "authority"), optional("Snapshot", "snapshot_id"),
        F.array(F.concat(F.lit("Extracted: "), F.coalesce(iso(F.col("extracted_at")), F.lit(""))), F.lit("")), F.flatten(F.transform("sections", section_markdown)),
    )
    text = joined(lines, "\n")
    if trimmed:
        text = F.concat(F.regexp_replace(text, f"[{JAVA_WHITE}]+$", ""), F.lit("\n"))
    return docs.select("url", *[c for c in ("path",) if c in docs.columns], text.alias("markdown"))
