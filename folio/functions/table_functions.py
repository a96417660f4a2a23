"""Table functions for SQL: what a text or page holds, as rows beside the rows that hold it.

    register(spark)
    spark.sql("SELECT d.doc_id, w.* FROM documents d, LATERAL chunk_windows(d.text, 4000) w")
    spark.sql("SELECT p.page_id, b.* FROM pages p, LATERAL page_elements(p.html, 'p') b")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from folio.functions.text import PY_WHITE
from folio.operators.html_nodes import flat
from folio.operators.htmltree import parse


def _expect(argument: AnalyzeArgument, kind: type, what: str) -> None:
    if not isinstance(argument.dataType, kind) and argument.dataType.typeName() != "void":
        raise ValueError(f"{what} must be of type {kind.typeName()}, not {argument.dataType.simpleString()}")


class ChunkWindows:
    """``chunk_windows(text, size)``: ``pos`` from 0 and ``part``, the text cut into strings of ``size`` characters; none for null and empty texts."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        _expect(text, StringType, "a text")
        if size is not None and (not size.isConstantExpression or not isinstance(size.value, int) or size.value < 1):
            raise ValueError("a size is a constant number from 1")
        return AnalyzeResult(StructType().add("pos", IntegerType()).add("part", StringType()))

    def eval(self, text: str | None, size: int = 4000) -> Iterator[tuple[int, str]]:
        for pos, at in enumerate(range(0, len(text or ""), size)):
            yield pos, text[at : at + size]


class PageElements:
    """``page_elements(html, tag)``: the elements of a page, all or those of one ``tag``, in document order: ``pre``, ``parent``, ``tag``, ``id`` and ``text`` with its white space normalised."""

    @staticmethod
    def analyze(html: AnalyzeArgument, tag: AnalyzeArgument | None = None) -> AnalyzeResult:
        _expect(html, StringType, "a page")
        if tag is not None:
            _expect(tag, StringType, "a tag")
        made = StructType()
        for name, kind in (("pre", IntegerType()), ("parent", IntegerType()), ("tag", StringType()), ("id", StringType()), ("text", StringType())):
            made = made.add(name, kind)
        return AnalyzeResult(made)

    def eval(self, html: str | None, tag: str | None = None) -> Iterator[tuple]:
        if html is None:
            return
        nodes = flat(parse(html)[0])
        white = PY_WHITE.replace(" - ", "".join(map(chr, range(0x2000, 0x200B))))
        blanks = str.maketrans(dict.fromkeys(white, " "))
        for pre, end, parent, _, name, _, own, *_ in nodes:
            if name is not None and tag in (None, name):
                text = "".join(x[5] for x in nodes[pre + 1 : end] if x[5] is not None)
                yield pre, parent, name, own, " ".join(w for w in text.translate(blanks).split(" ") if w)


def register(spark: SparkSession) -> None:
    """Names the functions of this module in SQL."""
    spark.udtf.register("chunk_windows", udtf(ChunkWindows))
    spark.udtf.register("page_elements", udtf(PageElements))
