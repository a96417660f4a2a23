"""Scalar functions over text, URLs and content types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space everywhere in this library.
WHITE = "\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
#: The same for Java's patterns: what lies below the first rare one is settled by one comparison.
JAVA_WHITE = f"\\t-\\r [\\x{{A0}}-\\x{{FEFF}}&&[{WHITE.split(' ')[1]}]]"
#: The same for Python's ``re``.
PY_WHITE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def falsy(x: Column) -> Column:
    """Null for an empty string, as a fallback chain wants it."""
    return F.nullif(x, F.lit(""))


def bound(x: Column, f) -> Column:
    """``f`` of ``x``, which is worked out once however often ``f`` names it: a plain call would repeat its whole expression each time."""
    return F.transform(F.array(x), f)[0]


def normalize_text(x: Column) -> Column:
    """White space runs become one blank, ends are trimmed, null becomes empty."""
    # Single blanks, which most are, are not matched: replacing them by themselves would cost more than all else.
    runs = f"[{JAVA_WHITE.replace(' ', '', 1)}][{JAVA_WHITE}]*| [{JAVA_WHITE}]+"
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), runs, " "))


#: Spellings of the path segments for "here" and "up".
HERE, UP = (".", "%2e"), ("..", ".%2e", "%2e.", "%2e%2e")
_DOTTED = r"(?i)(^|/)(\.|%2e){1,2}(/|$)"


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, with its dot segments resolved."""
    parts = F.slice(F.split(path, "/", -1), 2, F.size(F.split(path, "/", -1)))
    empty = F.array().cast("array<string>")

    def step(made: Column, part: Column) -> Column:
        up = F.slice(made, 1, F.greatest(F.size(made) - 1, F.lit(0)))
        return F.when(F.lower(part).isin(*HERE), made).when(F.lower(part).isin(*UP), up).otherwise(F.array_append(made, part))

    kept = F.aggregate(parts, empty, step)
    # A path that ends in a dot segment names a folder.
    kept = F.when(F.lower(F.element_at(parts, -1)).isin(*HERE, *UP), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _escaped(x: Column, unsafe: str) -> Column:
    """The characters of a class as percent signs and the hex of their UTF-8."""
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    made = F.array_join(F.transform(F.split(x, ""), lambda c: F.when(c.rlike(unsafe), code(c)).otherwise(c)), "")
    return F.when(x.rlike(unsafe), made).otherwise(x)


#: Web addresses that are normal already, their fragment aside; most are, and are told by one pattern.
_NORMAL = r"^https?://[a-z0-9-]+(\.[a-z0-9-]+)*/(?![^?#]*(?<=/)(\.|%2[eE]){1,2}([/?#]|$))[A-Za-z0-9_.~!$&'()*+,;=:@%/-]*(\?[A-Za-z0-9_.~!$&()*+,;=:@%/?-]*)?(#[\x21-\x7E]*)?$"


def normalize_url(url: Column) -> Column:
    """A URL without its fragment, as the URL standard writes web addresses.

    Scheme and host in lower case, hosts beyond ASCII in Punycode, default port
    dropped, empty path as ``/``, dot segments resolved, backslashes as slashes,
    unsafe characters as percent codes, line ends and tabs taken out.
    """
    return F.when(url.rlike(_NORMAL), F.substring_index(url, "#", 1)).otherwise(_normalized(url))


def _normalized(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\t\n\r]", ""), "#.*$", "")
    head = r"^([A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}[^/?\\]*)"

    def host_of_bare(bare: Column) -> Column:
        def ascii_host(host: Column) -> Column:
            # Only the name before a port goes through the JVM's IDN; a name that it refuses stays.
            name = F.regexp_extract(host, "^[^/]*//(?:[^@]*@)?([^:]*)", 1)
            return bound(name, lambda n: F.when(n.rlike("[^\\x00-\\x7F]"), F.replace(host, n, F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), n), n))).otherwise(host))

        lower = F.replace(F.lower(F.regexp_extract(bare, head, 1)), F.lit("\\"), F.lit("/"))
        return F.regexp_replace(F.regexp_replace(bound(lower, ascii_host), "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")

    def path_of(rest: Column, host: Column) -> Column:
        path = F.replace(F.regexp_extract(rest, r"^([^?]*)", 1), F.lit("\\"), F.lit("/"))
        path = bound(path, lambda p: F.when((host != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p))
        path = bound(path, lambda p: F.when((host != "") & p.rlike(_DOTTED), _without_dots(p)).otherwise(p))
        return bound(path, lambda p: _escaped(p, r"""[^\x21-\x7E]|["<>`{}^]"""))

    def whole(bare: Column) -> Column:
        rest = F.regexp_replace(bare, head, "")
        query = F.regexp_extract(rest, r"^[^?]*(.*)$", 1)
        return bound(host_of_bare(bare), lambda host: F.concat(host, path_of(rest, host), bound(query, lambda q: _escaped(q, r"""[^\x21-\x7E]|["<>']"""))))

    return bound(bare, whole)


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def fragment_of(url: Column) -> Column:
    """The part behind ``#``, null where there is none."""
    return falsy(F.regexp_extract(url, "#(.*)$", 1))


def _slug(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(x, "/$", ""), "[^A-Za-z0-9]+", "-")
    return F.lower(F.regexp_replace(x, "^-|-$", ""))


def document_id(url: Column) -> Column:
    """File-safe id from host, path, query and fragment."""
    port = F.regexp_replace(F.try_parse_url(url, F.lit("AUTHORITY")), "^.*@|:[0-9]+$", "")
    after = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return _slug(F.concat(F.coalesce(F.lower(port), F.lit("")), after))


def diff_id(url: Column) -> Column:
    """File-safe id from everything behind the scheme."""
    return _slug(F.regexp_replace(url, "^https?://", ""))


#: Content types and their file extensions.
EXTENSIONS = {
    "text/html": "html",
    "text/markdown": "md",
    "text/plain": "txt",
    "application/json": "json",
    "application/pdf": "pdf",
    "application/zip": "zip",
    "application/xml": "xml",
    "text/xml": "xml",
}


def extension_of(content_type: Column) -> Column:
    """File extension with its dot; ``.bin`` for what is unknown."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    out = F.lit(".bin")
    for name, extension in EXTENSIONS.items():
        out = F.when(kind == name, f".{extension}").otherwise(out)
    return out


def extension_or_own(content_type: Column, path: Column) -> Column:
    """As :func:`extension_of`, but a file's own extension where the type is unknown."""
    own = falsy(F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)))
    found = extension_of(content_type)
    return F.when(found == ".bin", F.coalesce(own, found)).otherwise(found)


def charset_of(content_type: Column) -> Column:
    """The charset a content type names, under one name for each; null where it names none."""
    raw = F.lower(F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("")), "(?i)charset=([^;]+)", 1)))
    return F.when(raw == "", None).when(raw == "utf-8", "utf8").when(raw == "us-ascii", "ascii").when(raw == "iso-8859-1", "latin1").otherwise(raw)


#: Charsets that can be decoded, and Spark's names for them; two more name bytes written as text.
CHARSETS = {
    "utf8": "UTF-8",
    "utf-8": "UTF-8",
    "ascii": "US-ASCII",
    "latin1": "ISO-8859-1",
    "binary": "ISO-8859-1",
    "utf16le": "UTF-16LE",
    "utf-16le": "UTF-16LE",
    "ucs2": "UTF-16LE",
    "ucs-2": "UTF-16LE",
}


def _seven_bits(content: Column) -> Column:
    """Bytes as ASCII text: a byte's high bit doesn't count."""
    high, low = "".join(map(chr, range(129, 256))), "".join(map(chr, range(1, 128)))
    # translate() drops what it maps to NUL, so the one byte that becomes NUL goes apart.
    return F.translate(F.replace(F.decode(content, "ISO-8859-1"), F.lit("\x80"), F.lit("\x00")), high, low)


def decoded(content: Column, charset: Column) -> Column:
    """Struct (text, warning): the bytes as text, with a warning where the charset is unknown and UTF-8 stands in."""
    name = F.coalesce(falsy(charset), F.lit("utf8"))
    text, known = F.make_valid_utf8(F.coalesce(content, F.lit(b"")).cast("string")), F.lit(False)
    for own, java in CHARSETS.items():
        if java == "US-ASCII":
            text = F.when(name == own, _seven_bits(content)).otherwise(text)
        elif java != "UTF-8":
            text = F.when(name == own, F.decode(content, java)).otherwise(text)
        known = known | (name == own)
    as_bytes = {"base64": F.base64(content), "base64url": F.rtrim(F.translate(F.base64(content), "+/", "-_"), F.lit("=")), "hex": F.lower(F.hex(content))}
    for own, written in as_bytes.items():
        text, known = F.when(name == own, written).otherwise(text), known | (name == own)
    warning = F.when(~known, F.concat(F.lit('Unsupported charset "'), name, F.lit('", decoded as utf8')))
    return F.struct(text.alias("text"), warning.alias("warning"))


def section_key(section_id: Column, ordinal: Column) -> Column:
    """A section's id with white space as dashes, else its number from 1."""
    return F.coalesce(F.regexp_replace(falsy(section_id), f"[{JAVA_WHITE}]+", "-"), F.concat(F.lit("section-"), (ordinal + 1).cast("string")))


def windows_of(text: Column, size: int = 4000) -> Column:
    """A text cut into strings of ``size`` characters."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def iso(ts: Column) -> Column:
    """A timestamp in UTC with milliseconds and ``Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
