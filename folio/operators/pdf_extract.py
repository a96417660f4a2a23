"""PDF files to one text per page, then to paragraphs like any text.

Reads what simple writers make: direct or Flate-packed content streams and the
operators that show strings.  What can't be read is a document with a warning.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(?:^|[\r\n\s])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_SHOWN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|(?<![\w.])(?:Tj|TJ|'|\")(?![\w])", re.S)
#: Escapes in strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def string_of(raw: bytes) -> str:
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = re.sub(
            rb"\\([0-7]{1,3}|\r?\n|.)",
            lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else b"" if m[1][:1] in b"\r\n" else _ESCAPES.get(m[1], m[1]),
            raw[1:-1],
            flags=re.S,
        )
    return data.decode("utf-16") if data[:2] in (b"\xfe\xff", b"\xff\xfe") else data.decode("cp1252", "replace")


def shown(content: bytes) -> list[str]:
    """The strings that a content stream shows, in order; the parts of one array are one string."""
    out, pending, inside = [], [], False
    for token in _SHOWN.findall(content):
        if token == b"[":
            pending, inside = [], True
        elif token == b"]":
            inside = False
        elif token[:1] in b"(<":
            pending = [*pending, string_of(token)] if inside else [string_of(token)]
        else:
            out.append("".join(pending))
            pending = []
    return [x for x in out if x]


def page_texts(data: bytes) -> list[str]:
    """One string a page; raises ValueError for what is no PDF."""
    if not data:
        raise ValueError("the file is empty")
    if b"%PDF-" not in data[:1024]:
        raise ValueError("no PDF header")
    objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}

    def stream(number: int) -> bytes:
        body = objects.get(number, b"")
        found = _STREAM.search(body)
        if not found:
            return b""
        return zlib.decompress(found[1]) if b"FlateDecode" in body[: found.start()] else found[1]

    pages = [body for _, body in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", body)]
    if not pages:
        raise ValueError("no pages found")
    out = []
    for page in pages:
        contents = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        numbers = [int(n) for n in _REFERENCE.findall(contents[1])] if contents else []
        out.append(" ".join(x for n in numbers for x in shown(stream(n))))
    return out


def pdf_text(content: Column) -> Column:
    """Struct (text, warning): pages joined by blank lines; a warning where nothing, or no PDF, was found; nulls for null."""

    @F.pandas_udf("text string, warning string")
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for data in contents:
            if data is None:
                rows.append((None, None))
                continue
            try:
                text = "\n\n".join(page_texts(bytes(data)))
                rows.append((text, None if text.strip() else "PDF extraction produced empty text"))
            except (ValueError, zlib.error, UnicodeError) as error:
                rows.append((None, f"PDF extraction failed: {error}"))
        return pd.DataFrame(rows, columns=["text", "warning"])

    return run(content)
