"""Line dedup by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: a line's number of tokens, then its leading tokens.
Tokens with a digit are variable fields from the start.  Behind the leading
tokens of a leaf, a token that enough of the leaf's lines have at its place is
constant, any other is a variable field, and lines with the same constants at the
same places form one template, if enough of these places are constant.  A
template that recurs in enough documents is dropped from all but the first of
them, and so is a line that recurs as it is in as many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import written

FIELD = "<*>"
BLANK = r"[ \t\x0B\f\r]+"
#: What a line holds if its tokens are not all between single blanks.
ODD_BLANKS = ("\t", "\x0b", "\f", "\r", "  ")
WITH_DIGIT = r"[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*"
#: Leading tokens of a path, and documents that a template, and a constant token, must be found in.
DEPTH, MIN_DOCS = 3, 10
#: Tenths: of a leaf's lines, that a constant token stands in; of the places behind the path, that are constant in a
#: template; of a line's tokens, that are no fields in a line which recurs as it is.
OFTEN, TENTHS, PLAIN = 1, 5, 5
#: Fewest tokens of a line that may be dropped: all lines are looked at.
MIN_TOKENS = 1
#: Rows that are broadcast, at most 200 bytes each in memory; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def masked(line: Column) -> Column:
    """The line's tokens between single blanks, those with digits replaced by the field mark."""
    # Most lines have neither digits nor odd blanks; a search is far cheaper than a replacement.
    fields = F.when(line.rlike("[0-9]"), F.regexp_replace(line, WITH_DIGIT, FIELD)).otherwise(line)
    odd = reduce(Column.__or__, (F.contains(line, F.lit(blank)) for blank in ODD_BLANKS))
    return F.trim(F.when(odd, F.regexp_replace(fields, BLANK, " ")).otherwise(fields))


def _lines(docs: DataFrame, min_tokens: int) -> DataFrame:
    """One row per line that may be a template: its document, place, path and tokens."""
    line = docs.select("key", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    # The generator of one row keeps the filter from being pushed down, where it would mask every line again.
    line = line.select("key", "row", "pos", F.explode_outer(F.array(masked(F.col("line")))).alias("tokens"))
    n = F.octet_length("tokens") - F.octet_length(F.replace("tokens", F.lit(" "), F.lit(""))) + 1
    line = line.where((n >= min_tokens) & (F.col("tokens") != ""))
    return line.select("key", "row", "pos", n.alias("size"), F.xxhash64(n, F.substring_index("tokens", " ", DEPTH)).alias("leaf"), F.xxhash64("tokens").alias("line"), "tokens")


def _small(df: DataFrame) -> DataFrame:
    """With a broadcast hint where the table, which is written, has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def recurring(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Lines to drop: ``key``, ``row`` and the sorted array ``drop`` of line numbers from 0."""
    lines = _lines(docs, min_tokens)
    at = written(lines.groupBy("leaf", "line", "key", "row").agg(F.array_sort(F.collect_set("pos")).alias("at")), "lines")
    pairs = at.select("leaf", "line", "key").distinct()
    leaves = written(pairs.groupBy("leaf").agg(F.count("*").alias("all")).where(F.col("all") >= MIN_DOCS), "leaves")
    body = lines.join(_small(leaves), "leaf", "left_semi").select("leaf", "line", "tokens", "size", "key").distinct()
    distinct = written(body.groupBy("leaf", "line").agg(F.min("tokens").alias("tokens"), F.min("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("first")), "bodies")
    # Places behind the path.
    token = distinct.where(F.col("size") > DEPTH).select("leaf", "line", "size", "n", F.posexplode(F.split("tokens", " ")).alias("i", "token")).where(F.col("i") >= DEPTH)
    constant = token.where(F.col("token") != FIELD).groupBy("leaf", "i", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS)
    constant = constant.join(_small(leaves), "leaf").where(10 * F.col("n") >= OFTEN * F.col("all"))
    seen = token.drop("n").join(constant.select("leaf", "i", "token", F.lit(True).alias("is_constant")), ["leaf", "i", "token"], "left")
    word = F.when(F.col("is_constant"), F.col("token")).otherwise(FIELD)
    template = (
        seen.groupBy("leaf", "line")
        .agg(F.array_sort(F.collect_list(F.struct("i", word.alias("w")))).alias("t"), F.count("is_constant").alias("constants"))
        .where(10 * F.col("constants") >= TENTHS * F.size("t"))
        .select("leaf", "line", F.sha2(F.array_join(F.transform("t", lambda x: x["w"]), " "), 256).alias("template"))
    )
    template = written(template, "templates")
    known = _small(template)
    often = pairs.join(known, ["leaf", "line"]).groupBy("leaf", "template", "key").agg(F.lit(1)).groupBy("leaf", "template")
    often = often.agg(F.count("*").alias("docs"), F.min("key").alias("first")).where(F.col("docs") >= MIN_DOCS)
    general = template.join(often, ["leaf", "template"]).select("leaf", "line", "first")
    fields = F.size(F.filter(F.split("tokens", " "), lambda x: x == FIELD))
    alike = distinct.where((F.col("n") >= MIN_DOCS) & (10 * (F.col("size") - fields) >= PLAIN * F.col("size"))).select("leaf", "line", "first")
    # A line of a recurring template goes by that, else by itself.
    both = general.withColumn("own", F.lit(0)).unionByName(alike.withColumn("own", F.lit(1)))
    bad = written(both.groupBy("leaf", "line").agg(F.min(F.struct("own", "first"))["first"].alias("first")), "recurring")
    hit = at.join(_small(bad), ["leaf", "line"]).where(F.col("key") > F.col("first"))
    return hit.groupBy("key", "row").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("drop"))


def drop_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``.

    Lines end at line feeds.  The document with the smallest ``doc_id`` keeps its
    lines of a template, all others lose theirs.  Blank lines, lines of which
    more than half the tokens have digits and that are alike in nothing else,
    and lines of fewer than ``min_tokens`` tokens stay.  A null text stays null
    with no lines dropped, an empty one is one empty line; rows of one
    ``doc_id`` are one document; a null ``doc_id`` counts as the smallest long.
    An empty table gives an empty result.  Texts of any length are taken whole,
    in time linear in it.  Columns named ``key``, ``row``, ``drop``, ``n_lines``
    or ``n_dropped`` of the input don't disturb; the last two are replaced.
    """
    own = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("row"), "text")
    drop = recurring(own.select("key", "row", "text"), min_tokens)
    joined = own.drop("text").join(drop, ["key", "row"], "left")
    lines = F.split(F.col("doc.text"), "\n", -1)
    # What lies between two dropped lines is a slice, so long texts stay linear.
    kept = F.expr(
        "flatten(transform(sequence(0, size(drop)), i -> slice(l, if(i = 0, 0, drop[i - 1] + 1) + 1, "
        "if(i = size(drop), size(l), drop[i]) - if(i = 0, 0, drop[i - 1] + 1))))"
    )
    out = joined.withColumn("l", lines).select(
        "doc",
        F.when(F.col("drop").isNull(), F.col("doc.text")).otherwise(F.array_join(F.when(F.col("drop").isNotNull(), kept), "\n")).alias("t"),
        F.coalesce(F.when(F.col("doc.text").isNotNull(), F.size("l")), F.lit(0)).cast("long").alias("a"),
        F.coalesce(F.when(F.col("drop").isNotNull(), F.size("drop")), F.lit(0)).cast("long").alias("b"),
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.col("t").alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in names], F.col("a").alias("n_lines"), F.col("b").alias("n_dropped"))


def without_boilerplate(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``docs`` without recurring lines; texts of which no line is left go."""
    out = drop_lines(docs, min_tokens).where(~((F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")))
    return out.select(*docs.columns)
