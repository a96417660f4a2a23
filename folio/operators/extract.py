"""Snapshots to documents: each text goes to the extractor that its entry or family names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.families import FAMILIES, Family, with_family
from folio.functions.text import decoded, document_id, falsy, fragment_of
from folio.operators import html_extract, pdf_extract, text_extract, xml_extract
from folio.operators.fragment import filter_by_fragment
from folio.operators.schema import DOCUMENT, EXTRACTED, SCHEMA_VERSION

EXTRACTORS = ("html", "xml", "text", "pdf")


def unsupported(extractor: Column, url: Column) -> Column:
    """A document without sections that says why."""
    warning = F.concat(F.lit('Unsupported content type for extractor "'), extractor, F.lit('"'))
    return F.struct(url.alias("title"), F.array().alias("sections"), F.array(warning).alias("warnings")).cast(EXTRACTED)


def with_warnings(extraction: Column, *more: Column) -> Column:
    both = F.concat(F.coalesce(extraction["warnings"], F.array().cast("array<string>")), F.filter(F.array(*more), lambda w: w.isNotNull()))
    return extraction.withField("warnings", both)


def extract(
    entries: DataFrame,
    run_ts: Column,
    rules: dict[str, dict] | None = None,
    extractors: tuple[str, ...] = EXTRACTORS,
    families: tuple[Family, ...] = FAMILIES,
    own_extractors: dict[str, Callable[[Column, Column], Column]] | None = None,
) -> DataFrame:
    """Documents of manifest entries that carry their snapshot (``content``, ``content_type``, ``charset``, ``snapshot_id``).

    HTML and XML go their own way, through tables of nodes; all other entries take
    one pass, in which every parser sees nulls but for its own rows.  Where it is
    known which extractors occur, naming them leaves the others out of the plan;
    with ``text`` alone no Python runs and nothing is shuffled.  ``run_ts`` stamps
    all documents of a run.  A page that is not ``text/html`` and an unknown
    extractor give documents without sections and a warning.

    ``families`` are resolved in their order; ``rules`` replaces the HTML rules of
    a family by its id.  ``own_extractors`` adds extractors by name, each a
    function of the columns of text and URL that gives a column of ``EXTRACTED``.
    """
    own_extractors = own_extractors or {}
    rules = {f.id: f.html_rules() for f in families} | (rules or {})
    rows = with_family(entries, families)
    url = F.col("url")
    is_html = F.coalesce(F.contains(F.col("content_type"), F.lit("text/html")), F.lit(False))
    route = F.when((F.col("extractor") == "html") & ~is_html, "none").when(F.col("extractor").isin(*extractors, *own_extractors), F.col("extractor")).otherwise("none")
    rows = rows.withColumn("route", route).withColumn("t", decoded(F.col("content"), F.col("charset")))

    def own(name: str, x: Column) -> Column:
        return F.when(F.col("route") == name, x)

    text, warning = F.col("t.text"), F.col("t.warning")
    keep = [c for c in ("doc_seq", "output", "label") if c in entries.columns]
    head = [*keep, "url", "family", "authority", "document_type", "snapshot_id"]
    # Pages and XML go their own way, through tables of their nodes.
    apart = {"html": lambda part: html_extract.extract_pages(part, rules=rules), "xml": xml_extract.extract_texts}
    parts = {name: rows.where(F.col("route") == name).select(*head, text.alias("text"), warning.alias("warning")) for name in apart if name in extractors and name not in own_extractors}
    rows = rows.where(~F.col("route").isin(*parts))
    made = {}
    if "text" in extractors:
        made["text"] = with_warnings(text_extract.extracted(text, url), warning)
    if "pdf" in extractors:
        rows = rows.withColumn("p", pdf_extract.pdf_text(own("pdf", F.col("content"))))
        made["pdf"] = with_warnings(text_extract.extracted(F.col("p.text"), url), F.col("p.warning"))
    for name, function in own_extractors.items():
        made[name] = with_warnings(function(own(name, text), url).cast(EXTRACTED), warning)
    extraction = unsupported(F.col("extractor"), url)
    for name, x in made.items():
        extraction = F.when(F.col("route") == name, x).otherwise(extraction)
    docs = rows.select(*head, extraction.alias("e"))
    for name, part in parts.items():
        docs = docs.unionByName(apart[name](part).select(*head, with_warnings(F.col("e"), F.col("warning")).alias("e")))
    docs = docs.select(
        *keep, F.lit(SCHEMA_VERSION).alias("schema_version"), "url", F.col("e.title").alias("title"), "family", "authority", "document_type", "snapshot_id",
        fragment_of(url).alias("fragment"), run_ts.alias("extracted_at"), F.col("e.sections").alias("sections"), F.col("e.warnings").alias("warnings"),
    )
    return filter_by_fragment(docs).select(*keep, *DOCUMENT)


def output_path(override: Column, family: Column, url: Column, folder: str = "specs", fmt: str = "json") -> Column:
    """Where a document goes: the entry's own path with an extension, else family and id below the folder."""
    own = falsy(override)
    named = F.when(own.endswith(f".{fmt}"), own).otherwise(F.concat(own, F.lit(f".{fmt}")))
    named = F.when(named.startswith("/"), named).otherwise(F.concat(F.lit(f"{folder}/"), named))
    return F.coalesce(named, F.concat(F.lit(f"{folder}/"), family, F.lit("/"), document_id(url), F.lit(f".{fmt}")))
