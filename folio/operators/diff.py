"""Differences between two versions of a corpus, section by section, from digests.

A document is reduced once to its ``sections`` (hash and id of each, in the order
of their places) and one ``digest`` over them: a row without text.  Kept in a
table bucketed by URL, two versions are compared without a shuffle and without
reading a document again, and equal digests end the comparison of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import diff_id, falsy, iso, normalize_text
from folio.operators.chunk import definition_lines, joined, table_lines

#: Characters of a section's hash, in front of its id.
HASH = 64


def section_text(blocks: Column) -> Column:
    """Text that counts for a difference; algorithms and grammars don't."""

    def lines(b: Column) -> Column:
        kind = b["type"]
        empty = F.array().cast("array<string>")
        return (
            F.when(kind.isin("paragraph", "note", "code"), F.array(b["text"]))
            .when(kind == "list", F.array(joined(b["items"], "\n")))
            .when(kind == "definitionList", F.coalesce(definition_lines(b), empty))
            .when(kind == "table", table_lines(b))
            .otherwise(empty)
        )

    return normalize_text(joined(F.flatten(F.transform(blocks, lines)), "\n"))


def digests(docs: DataFrame) -> DataFrame:
    """``url``, ``snapshot_id``, ``digest`` and ``sections`` of each document, of documents with one URL the last.

    Sections with one id are one, at the first's place with the last's text.  Rows
    without ``doc_seq`` tie, and the largest snapshot id is the last.
    """
    order = F.struct((F.col("doc_seq") if "doc_seq" in docs.columns else F.lit(0)).alias("seq"), F.coalesce("snapshot_id", F.lit("")).alias("snapshot"))
    name = lambda s: F.coalesce(falsy(s["id"]), F.concat(F.lit("section-"), (s["ordinal"] + 1).cast("string")))
    one = lambda s: F.struct(name(s).alias("id"), s["ordinal"].alias("place"), F.sha2(section_text(s["blocks"]), 256).alias("hash"))
    named = F.array_sort(F.transform(F.filter(F.coalesce("sections", F.array()), lambda s: s.isNotNull()), one))
    rows = docs.select("url", "snapshot_id", order.alias("order"), named.alias("s"))
    s = F.col("s")
    # By id and place, so that neighbours tell the first and the last of an id; both lists have the ids in one order.
    first = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["id"] != x["id"]))
    last = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["id"] != x["id"]))
    placed = F.array_sort(F.zip_with(first, last, lambda a, b: F.struct(a["place"].alias("place"), F.concat(b["hash"], a["id"]).alias("entry"))))
    entries = F.transform(placed, lambda x: x["entry"])
    rows = rows.select("url", "snapshot_id", "order", entries.alias("sections"))
    digest = F.sha2(F.to_json(F.array_sort("sections")), 256)
    rows = rows.select("url", F.struct("snapshot_id", digest.alias("digest"), "sections").alias("d"), "order")
    return rows.groupBy("url").agg(F.max_by("d", "order").alias("d")).select("url", "d.snapshot_id", "d.digest", "d.sections")


def save_digests(docs: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """The digests of a version as the table ``table`` at ``path``, bucketed and sorted by URL, so that diffs need no shuffle."""
    digests(docs).repartition(buckets, "url").write.mode("overwrite").bucketBy(buckets, "url").sortBy("url").option("path", path).saveAsTable(table)


def diff_digests(old: DataFrame, new: DataFrame, run_ts: Column | None = None) -> DataFrame:
    """One row per URL in both: counts and ids of added, removed and changed sections, unchanged documents included."""
    side = lambda x, name: x.select("url", F.col("snapshot_id").alias(f"{name}_snapshot"), F.col("digest").alias(f"{name}_digest"), F.col("sections").alias(f"{name}_sections"))
    both = side(old, "from").join(side(new, "to"), "url")
    same = F.col("from_digest") == F.col("to_digest")
    ids = lambda entries: F.transform(entries, lambda x: F.substr(x, F.lit(HASH + 1)))
    empty = F.array().cast("array<string>")
    # array_except keeps the order of its first array: that of the sections' places.
    rows = both.withColumns({"gone": F.when(~same, F.array_except("from_sections", "to_sections")), "come": F.when(~same, F.array_except("to_sections", "from_sections"))})
    rows = rows.withColumns({"gone": ids(F.col("gone")), "come": ids(F.col("come"))})
    lists = {"added": F.array_except("come", "gone"), "removed": F.array_except("gone", "come"), "changed": F.array_intersect("come", "gone")}
    out = rows.select("url", "from_snapshot", "to_snapshot", *[F.coalesce(c, empty).alias(n) for n, c in lists.items()])
    stamp = iso(run_ts) if run_ts is not None else F.lit(None).cast("string")
    summary = F.struct(*[F.size(n).alias(n) for n in lists])
    return out.select("url", "from_snapshot", "to_snapshot", stamp.alias("changed_at"), summary.alias("summary"), *lists, F.concat(diff_id(F.col("url")), F.lit(".diff.json")).alias("path"))


def diff_documents(old: DataFrame, new: DataFrame, run_ts: Column | None = None) -> DataFrame:
    """As :func:`diff_digests`, of two tables of documents."""
    return diff_digests(digests(old), digests(new), run_ts)
