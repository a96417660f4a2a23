"""Keeps of a document what its URL's fragment names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import fragment_of, normalize_text


def filter_by_fragment(docs: DataFrame) -> DataFrame:
    """Sections with the fragment as id; else, of the first section with such blocks, these blocks; else all, with a warning.

    A URL without a fragment keeps its document as it is.
    """
    wanted = fragment_of(F.col("url"))

    def hits(section):
        return F.filter(section["blocks"], lambda b: (b["id"].eqNullSafe(F.col("wanted"))) | (b["source"]["fragment"].eqNullSafe(F.col("wanted"))))

    docs = docs.withColumn("wanted", wanted)
    sections = F.filter("sections", lambda s: s["id"] == F.col("wanted"))
    named = F.transform(sections, lambda s: s.withField("heading", F.coalesce(F.nullif(s["heading"], F.lit("")), normalize_text(s["id"]))))
    holding = F.filter("sections", lambda s: F.size(hits(s)) > 0)
    reduced = F.transform(F.slice(holding, 1, 1), lambda s: s.withField("blocks", hits(s)))
    missing = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array(F.concat(F.lit("Fragment not found: "), F.col("wanted"))))
    kind = F.when(F.col("wanted").isNull(), "all").when(F.size(sections) > 0, "section").when(F.size(holding) > 0, "block").otherwise("none")
    return docs.withColumn("kind", kind).withColumns(
        {
            "sections": F.when(F.col("kind") == "section", named).when(F.col("kind") == "block", reduced).otherwise(F.col("sections")),
            "warnings": F.when(F.col("kind") == "none", missing).otherwise(F.col("warnings")),
        }
    ).drop("wanted", "kind")
