"""Plain text to paragraphs, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import falsy, normalize_text
from folio.operators.schema import EXTRACTED


def paragraphs(text: Column) -> Column:
    """Texts between blank lines, white space normalised, empty ones left out."""
    unix = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return F.filter(F.transform(F.split(unix, "\n{2,}"), normalize_text), lambda x: x != "")


def extracted(text: Column, url: Column, title: Column | None = None) -> Column:
    """One section of paragraphs, as the other extractors give it."""
    title = falsy(title) if title is not None else F.lit(None).cast("string")
    null = F.lit(None)
    blocks = F.transform(
        paragraphs(text),
        lambda x, i: F.struct(
            i.alias("ordinal"), F.concat(F.lit("p-"), (i + 1).cast("string")).alias("id"), F.lit("paragraph").alias("type"), x.alias("text"),
            *[null.alias(n) for n in ("ordered", "items", "definitions", "headers", "rows", "title", "steps", "productions", "normativity", "links", "source")],
        ),
    )
    section = F.struct(F.lit(0).alias("ordinal"), null.alias("id"), F.coalesce(title, F.lit("Document")).alias("heading"), F.lit(1).alias("level"), null.alias("source"), blocks.alias("blocks"))
    return F.struct(F.coalesce(title, url).alias("title"), F.array(section).alias("sections"), F.array().cast("array<string>").alias("warnings")).cast(EXTRACTED)
