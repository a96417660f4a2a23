"""Known licences are found in any line breaks, and no altered clause is."""

import os
import re
import textwrap

import pytest

from folio.llm import license_scan

FOLDER = "/usr/share/common-licenses"
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def texts():
    return {name: open(f"{FOLDER}/{f}", encoding="utf-8", errors="replace").read() for f, name in FILES.items() if os.path.exists(f"{FOLDER}/{f}")}


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["license"] for r in license_scan.license_scan(docs, lines=False).collect()}


def laid_out(text, width):
    """Paragraphs wrapped anew, or each on a line."""
    parts = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    return "\n\n".join(textwrap.fill(p, width) if width else p for p in parts)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licences on this machine")
def test_any_line_breaks(spark):
    rows, want = [], {}
    for name, text in texts().items():
        for width in (40, 60, 72, 90, 0):
            want[len(rows)] = name
            rows.append((len(rows), laid_out(text, width)))
        want[len(rows)] = name
        rows.append((len(rows), " ".join(text.split())))
    assert found(spark, rows) == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licences on this machine")
def test_no_altered_clause(spark):
    """A word more or less in any paragraph, or another clause behind an enumerator, and the licence is another one."""
    rows = []
    for text in texts().values():
        parts = [p for p in re.split(r"\n\s*\n", text) if len(p.split()) > 3]
        # Behind the end of the terms stands advice, which a copy may leave out.
        body = re.split(r"\n\s*(?:END OF TERMS AND CONDITIONS|ADDENDUM:)", text)[0]
        for part in parts:
            if part in body:
                words = [w for w in part.split() if re.search(r"[^\W_]", w)]  # rules and blanks to fill in are no words
                for changed in ([*words[:2], "not", *words[2:]], words[:-1]):
                    rows.append((len(rows), text.replace(part, " ".join(changed), 1)))
    rows.append((len(rows), re.sub(r"\(c\) You must retain.*?\n\s*\n", "(c) You may do as you please with all of it\n\n", texts()["Apache-2.0"], flags=re.S)))
    assert len(rows) > 1000 and set(found(spark, rows).values()) == {None}


def test_statements_and_enumerators(spark):
    bodies = {name: body for name, body in license_scan.KNOWN[::-1] if len(body) > 300}
    mit = bodies["MIT"].removeprefix("MIT License\nCopyright (c) holders\n")
    bsd = bodies["BSD-2-Clause"].removeprefix("All rights reserved.\n")
    first, second = (m.start() for m in re.finditer("Redistributions", bsd))
    marked = f"{bsd[:first].strip(' 1.')}\n(a) {bsd[first:second].strip(' 2.')}.\n(b) {bsd[second:]}"
    rows = [
        (0, "Copyright (c) 2020 A Company,\n B Company\n\n" + mit), (1, "Copyright (c) 2020 A and\nB Company\n" + mit), (2, "(c) 2021 Somebody\n" + mit), (3, marked),
        (4, "(c) You may not use it\n" + mit), (5, "Copyright (c) 2020 A Company\nYou may not use it\n" + mit), (6, "Copyright (c) 2020 A Company,\nB Company\nand nobody else\n" + mit),
    ]
    assert found(spark, rows) == {0: "MIT", 1: "MIT", 2: "MIT", 3: "BSD-2-Clause", 4: None, 5: None, 6: None}
