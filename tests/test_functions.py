"""Scalar functions and families on literals."""

import pytest
from pyspark.sql import functions as F

from folio.functions import text as fx
from folio.functions.families import FAMILIES, resolve_family, with_family


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [(" a \t\n b ", "a b"), ("a  b　c﻿", "a b c"), (None, ""), ("\x85x\x1c", "\x85x\x1c"), ("", "")],
)
def test_normalize_text(spark, raw, clean):
    assert one(spark, fx.normalize_text(F.col("t")), t=raw) == clean


@pytest.mark.parametrize(
    ("url", "normal", "slug", "fragment"),
    [
        ("https://A.Example/b/c/?q=1#frag", "https://a.example/b/c/?q=1", "a-example-b-c-q-1-frag", "frag"),
        ("http://x.example:80", "http://x.example/", "x-example", None),
        ("https://x.example:8443/a#", "https://x.example:8443/a", "x-example-a", None),
        ("https://x.example/a/", "https://x.example/a/", "x-example-a", None),
    ],
)
def test_urls(spark, url, normal, slug, fragment):
    u = F.col("u")
    assert (one(spark, fx.normalize_url(u), u=url), one(spark, fx.document_id(u), u=url), one(spark, fx.fragment_of(u), u=url)) == (normal, slug, fragment)


def test_diff_id_keeps_the_port(spark):
    assert one(spark, fx.diff_id(F.col("u")), u="https://x.example:8443/a/") == "x-example-8443-a"


@pytest.mark.parametrize(("kind", "path", "extension"), [("text/html; charset=x", "a.txt", ".html"), ("image/png", "a/b.PNG", ".png"), (None, "noext", ".bin"), ("application/pdf", "", ".pdf")])
def test_extension(spark, kind, path, extension):
    assert one(spark, fx.extension_or_own(F.col("k"), F.col("p")), k=kind, p=path) == extension


@pytest.mark.parametrize(
    ("content", "charset", "text", "warned"),
    [("é".encode(), None, "é", False), ("é".encode("latin-1"), "latin1", "é", False), ("é".encode("utf-16-le"), "utf16le", "é", False), ("é".encode(), "windows-1252", "é", True), (b"\xff", "utf8", "�", False)],
)
def test_decoded(spark, content, charset, text, warned):
    got = one(spark, fx.decoded(F.col("c"), F.col("s")), c=content, s=charset)
    assert (got["text"], got["warning"] is not None) == (text, warned)


def test_section_key_and_windows(spark):
    assert one(spark, fx.section_key(F.col("s"), F.lit(2)), s="a b\tc") == "a-b-c"
    assert one(spark, fx.section_key(F.col("s"), F.lit(2)), s="") == "section-3"
    assert one(spark, fx.windows_of(F.col("s"), 3), s="abcdefg") == ["abc", "def", "g"]
    assert one(spark, fx.windows_of(F.col("s"), 3), s="") == []


@pytest.mark.parametrize(
    ("url", "asked", "family"),
    [
        ("https://www.w3.org/TR/", None, "w3c"), ("https://html.spec.whatwg.org/x", None, "whatwg"), ("https://xunicode.org/", None, "unicode"), ("https://core.ac.uk/", None, "core"),
        ("https://a.core.ac.uk/", None, "core"), ("https://core.ac.uk.evil.example/", None, "generic"), ("https://e.example/", "rfc", "rfc"), ("https://tc39.es/", "nobody", "tc39"), ("mailto:x", None, "generic"),
    ],
)
def test_family(spark, url, asked, family):
    assert one(spark, resolve_family(F.col("u"), F.col("a")), u=url, a=asked) == family


def test_entry_values_come_first(spark):
    rows = spark.createDataFrame([("https://www.rfc-editor.org/rfc/1", None, None, None), ("https://arxiv.org/a", "", "draft", "pdf")], "url string, family string, authority string, extractor string")
    got = {r["family"]: (r["authority"], r["extractor"], r["document_type"]) for r in with_family(rows).collect()}
    assert got == {"rfc": ("normative", "html", None), "arxiv": ("draft", "pdf", "paper")}
    assert len({f.id for f in FAMILIES}) == 17
