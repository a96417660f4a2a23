"""License scan by canonical digest.

A text and each known licence are brought to canonical forms (case, punctuation,
white space, line breaks and equivalent spellings no longer count), digested, and
joined by digest.  Entire texts are compared, never parts of one; a document's
lines may be scanned as texts of their own, for notices.

There are two forms.  In the full one every word counts: it is that of licences
that are handed on word for word, statements of copyright included.  In the bare
one statements of copyright and titles are left out, which differ from copy to
copy of the short licences.  A statement starts a line and ends with it, or, where
the line ends in a comma, "and", "by" or "&", with the next; an enumerator "(c)"
starts none unless a year follows.  A text is known by either form.

Lines are brought to their form once; the entire text is its lines' words end to
end.  Of the lines, only those as long as a known notice are digested.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, written

#: Spellings that count as the same word in a licence.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("http", "https"),
    ("v 2 0", "version 2 0"),
    ("v2 0", "version 2 0"),
)

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: {0} Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. {1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "{2} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. "
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: The clauses are numbered, or marked with signs that don't count.
_BULLETS = (("", "", ""), ("1.", "2.", "3."), ("(a)", "(b)", "(c)"))
_RESERVED = ("", "All rights reserved.\n")
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    "software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
    "above copyright notice and this permission notice{0} shall be included in all copies or substantial portions of the "
    "Software. "
)
_ISC = "Permission to use, copy, modify, and{0} distribute this software for any purpose with or without fee is hereby granted, "
#: Public licences in their customary layouts, and the one-line notices that stand for one.
KNOWN = (
    ("MIT", "MIT License\nCopyright (c) holders\n" + _MIT.format("") + _WARRANTY),
    ("MIT", _MIT.format(" (including the next paragraph)") + _WARRANTY),
    *(("ISC", _ISC.format(way) + "provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY) for way in ("/or", "")),
    ("0BSD", _ISC.format("/or")[:-2] + ". " + _ISC_WARRANTY),
    *(("BSD-2-Clause", reserved + (_BSD + _BSD_WARRANTY).format(*marks)) for reserved in _RESERVED for marks in _BULLETS),
    *(("BSD-3-Clause", reserved + (_BSD + _BSD_THIRD + _BSD_WARRANTY).format(*marks)) for reserved in _RESERVED for marks in _BULLETS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
)
#: Digests of the full forms of licences too long to print here, as their publishers distribute them;
#: where a licence ends in advice how to apply it, with and without that, and with and without the line before it.
KNOWN_DIGESTS = (
    ("Apache-2.0", 9929, "8318fc18753641674a0b35f73f00e865e8cceb1ed8b6eb85f62d4a5d5146a5f1"),
    ("Apache-2.0", 8872, "6530dac82be99e5bbcc128a6caf5bfdd0451a21fe23ac3df15ed85a1c550c859"),
    ("Apache-2.0", 8844, "2b4a3f34572f63637f58db72bdacad38516a1e1e6788b08931d0a0d5c0be33dd"),
    ("Artistic-1.0-Perl", 5833, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 19667, "61501da4fb94cceda16cd9affa2c77a91451ac2041c3baac644d4090c86855de"),
    ("GFDL-1.2", 18443, "54ac735272717aced6ea284772b1c97ffbffb0fb718ed7ca609ec1fcbe6e8898"),
    ("GFDL-1.3", 22113, "cdf3d9ad52a468f1e3a38b3cd70b6b38978b4acbb41cceee134bf4e2e6168fe4"),
    ("GFDL-1.3", 20889, "d651ff1557654d5aa24f6f7f68987b58e8d376b75beba4cab39a2dbf27de6930"),
    ("GPL-1.0", 11843, "d408d9dad6e4560274412e743ec3ba01007197655029f60544c308bc54f80499"),
    ("GPL-1.0", 9461, "90b42d1cf0f9ef747c945cda0a54d5bd16341c8491956c54b3f4f283efa0176a"),
    ("GPL-1.0", 9433, "24bc5345819daf657c4709aebe2be24875e021dde1ced86cd813b9ae9ae62a60"),
    ("GPL-2.0", 17200, "0bfb659bf7eeb9921df1446a6a93beba70e0dc947eec10a42d26bb310dccd498"),
    ("GPL-2.0", 14534, "8607b1cff63e9a9dc468bf76327bdd0bb2d2abe09d6e8076427fd49236f46f29"),
    ("GPL-2.0", 14506, "e1bcfaf28e42eba7ac6b0aa31f0165c8241a74641090fe675acc693f1a3e5df1"),
    ("GPL-3.0", 33501, "7d478223d8fcde6480339b8bbaadacf6b93d7007d04a13fbd30f71a80fd981a0"),
    ("GPL-3.0", 31028, "d9de3adc6f88fd297c319c8e5efae6a00c1606770b4d22bd8fdc95a7071b5251"),
    ("GPL-3.0", 31000, "c5dfddbc99d5359297177162fc4dba244c813c2b1d105bae18b52b8c9eca813e"),
    ("LGPL-2.0", 24208, "9ccbf81e2fd78db81966e466a22ed39318d0a4b4550cd69d1144dcf09722ff10"),
    ("LGPL-2.0", 22323, "9e78fa98415a9a8c863589ab742457328d22cd2319bbf585de04b27baf33a2be"),
    ("LGPL-2.0", 22295, "a1d17eaee69b0acf82494ed25367a5de1fc23474406d17ff81a7b1ee484363e2"),
    ("LGPL-2.1", 25300, "a9cc8dda4023821e198a2e1bee36afc3e68fce90828780c7bac37ffe33565e15"),
    ("LGPL-2.1", 23416, "f13ce8aa4b0cc0de7c3b73a95e705f217972ef8710e7c0a463342682e2e523de"),
    ("LGPL-2.1", 23388, "e8ebe2513d0bd90d40bb6e894699a044e69aa9b44afada1fb47e767c3fed7f15"),
    ("LGPL-3.0", 7164, "3ce770135de37fc153de7af30789ebf6cf1e9ad54eb9b487647ea8aa9ccae9c2"),
    ("MPL-1.1", 22468, "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", 14354, "4544af666fc42fe3ea03e86d5db9fef4f4c41c50c15f04550119fdb67822747b"),
)

#: Lines that are no more than a licence's title, in canonical form.
TITLES = (
    "mit license", "the mit license", "the mit license mit", "mit license mit", "isc license", "the isc license", "the isc license isc", "isc license isc",
    "bsd 2 clause license", "the bsd 2 clause license", "bsd 3 clause license", "the bsd 3 clause license", "bsd license", "the bsd license", "new bsd license",
    "simplified bsd license", "modified bsd license", "bsd zero clause license", "zero clause bsd", "zero clause bsd license",
)

#: Lengths of notices that are compared before a line is digested; with more of them every line is.
LENGTHS = 1_000
#: What a null id counts as.
NO_ID = -(1 << 63)

#: A statement of copyright: behind comment marks, the word or the sign, then a year, the sign, "by", a blank to fill in or a name.
COPYRIGHT_LINE = (
    r"^[^\p{L}\p{N}(©]*(\([cC]\)[ \t]*[0-9]{4}|©|[cC](opyright|OPYRIGHT)([ \t]*[:,]?[ \t]*(\([cC]\)|©|[0-9]{4}|[bB][yY] |[\[<{]))|Copyright (The |the )?[A-Z][a-z])"
)
NOT_A_COPYRIGHT_LINE = r"^[^\p{L}\p{N}(©]*Copyright (The |the )?(Notice|Holder|Owner|License|Licence|Law|Statement)"
#: How a statement's line ends that goes on in the next one.
GOES_ON = r"(,|&|\b[aA]nd|\b[bB]y)[ \t\r]*$"
NOT_A_WORD = r"[^\p{L}\p{N} ]+"


def line_form(line: Column) -> Column:
    """A line in lower case, its words between single blanks."""
    # Most blanks are single already; a replacement for each of them would cost more than all else.
    x = F.trim(F.regexp_replace(F.lower(line), NOT_A_WORD, " "))
    return F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " {2,}", " ")).otherwise(x)


def is_copyright(line: Column) -> Column:
    # The sign or the word is looked for before the pattern is tried.
    maybe = F.contains(line, F.lit("opyright")) | F.contains(line, F.lit("OPYRIGHT")) | F.contains(line, F.lit("©")) | F.contains(line, F.lit("(c)")) | F.contains(line, F.lit("(C)"))
    return maybe & line.rlike(COPYRIGHT_LINE) & ~line.rlike(NOT_A_COPYRIGHT_LINE)


def one_spelling(words: Column) -> Column:
    """Words between single blanks, each in the one spelling that stands for it."""
    wide = lambda x: f" {x.replace(' ', '  ')} "
    # Two blanks between words, so that neighbours don't share one.
    x = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for other, one in SPELLINGS:
        x = F.replace(x, F.lit(wide(other)), F.lit(wide(one)))
    return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))


def goes_on(before: Column) -> Column:
    """Whether the line before starts a statement that it doesn't end."""
    return F.coalesce(before["starts"] & before["line"].rlike(GOES_ON), F.lit(False))


def line_forms(text: Column) -> Column:
    """Per line with words: the ``words``, whether it is of a ``copyright`` statement, and whether it does ``count`` in the bare form."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), is_copyright(x).alias("starts")))
    # Bound to a name, so that a line can look at the one before it.
    lines = F.transform(F.array(lines), lambda all_lines: F.transform(all_lines, lambda x, i: F.struct(line_form(x["line"]).alias("words"), (x["starts"] | goes_on(F.get(all_lines, i - 1))).alias("copyright"))))[0]
    return F.transform(F.filter(lines, lambda x: x["words"] != ""), lambda x: F.struct(x["words"].alias("words"), x["copyright"].alias("copyright"), (~x["copyright"] & ~x["words"].isin(*TITLES)).alias("count")))


def full_form(forms: Column) -> Column:
    """The full canonical form of an entire text from those of its lines."""
    return one_spelling(F.array_join(F.transform(forms, lambda x: x["words"]), " "))


def whole_form(forms: Column) -> Column:
    """The bare canonical form of an entire text from those of its lines."""
    return one_spelling(F.array_join(F.transform(F.filter(forms, lambda x: x["count"]), lambda x: x["words"]), " "))


#: What a text must hold for any spelling to differ.
_ODD = ("licence", "sub licen", "non commercial", "per cent", "copyright owner", "acknowledgement", "favour", "merchantibility", "http", "v 2 0", "v2 0")


def digest(text: Column) -> Column:
    """SHA-256 of the bare form in hex; null where no word is left."""
    x = whole_form(line_forms(text))
    return F.when(x != "", F.sha2(x, 256))


def known_digests(spark: SparkSession, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """One row per distinct canonical licence text: ``digest``, ``license`` and ``length`` of the form."""
    rows = spark.createDataFrame(list(known), "license string, body string").select("license", whole_form(line_forms(F.col("body"))).alias("form")).where("form <> ''")
    rows = rows.select(F.sha2("form", 256).alias("digest"), "license", F.length("form").alias("length"))
    rows = rows.unionByName(spark.createDataFrame([(d, name, n) for name, n, d in digests], "digest string, license string, length int"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.min("length").alias("length"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, lines: bool = True, broadcast_rows: int = 100_000) -> DataFrame:
    """Per document: ``text_digest`` of the bare form, ``license`` of the entire text, and of its lines ``n_notices`` and ``notices``.

    ``known`` (``digest`` of either form, ``license``, and ``length`` of the form, or null) is
    counted and broadcast up to ``broadcast_rows`` rows of some hundred bytes
    each, joined by shuffle beyond.  Null, empty and wordless texts get a null
    digest and no licence.  Repeated rows are scanned each; rows of one
    ``doc_id``, and those of a null one, share their notices.  Texts of any
    length are taken whole, in time linear in it.  An empty table gives an empty
    result; other columns are dropped, whatever their names.
    """
    docs = documents(docs)
    known = known_digests(docs.sparkSession) if known is None else known
    lengths = [r[0] for r in known.select("length").distinct().limit(LENGTHS + 1).collect()]
    if known.limit(broadcast_rows + 1).count() <= broadcast_rows:
        known = F.broadcast(known)
    known = known.select(F.col("digest").alias("known_digest"), "license")
    # Generators of one row keep the optimizer from working out the forms again for every use.
    forms = docs.select("doc_id", F.explode_outer(F.array(line_forms(F.col("text")))).alias("f"))
    odd = reduce(Column.__or__, (F.contains("all", F.lit(x)) for x in _ODD))
    forms = forms.select("doc_id", "f", F.explode_outer(F.array(F.array_join(F.transform("f", lambda x: x["words"]), " "))).alias("all")).select("doc_id", "f", "all", odd.alias("odd"))
    full = F.when(F.col("odd"), one_spelling(F.col("all"))).otherwise(F.col("all"))
    whole = F.array_join(F.transform(F.filter("f", lambda x: x["count"]), lambda x: x["words"]), " ")
    whole = F.when(F.col("odd"), one_spelling(whole)).otherwise(whole)
    words = F.transform(F.filter("f", lambda x: ~x["copyright"]), lambda x: x["words"])
    words = F.when(F.col("odd"), F.transform(words, one_spelling)).otherwise(words)
    # A line as long as no known notice is none.
    fits = (lambda x: F.lit(True)) if None in lengths or len(lengths) > LENGTHS else (lambda x: F.length(x).isin(*lengths))
    notices = F.transform(F.filter(words, fits), lambda x: F.sha2(x, 256)) if lines else F.array().cast("array<string>")
    rows = forms.select("doc_id", F.explode_outer(F.array(whole)).alias("whole"), F.sha2(full, 256).alias("full_digest"), notices.alias("notices"))
    rows = written(rows.select("doc_id", F.when(F.col("whole") != "", F.sha2("whole", 256)).alias("text_digest"), "full_digest", "notices"), "forms")
    by_full = known.select(F.col("known_digest").alias("full_digest"), F.col("license").alias("full_license"))
    out = rows.join(known, F.col("text_digest") == F.col("known_digest"), "left").join(by_full, "full_digest", "left")
    out = out.select("doc_id", "text_digest", F.coalesce("license", "full_license").alias("license"))
    if not lines:
        return out
    found = rows.select("doc_id", F.explode("notices").alias("notice")).join(known, F.col("notice") == F.col("known_digest"))
    found = found.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    out = out.join(found, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("id"), "left").drop("id")
    return out.withColumns({"n_notices": F.coalesce("n_notices", F.lit(0).cast("long")), "notices": F.coalesce("notices", F.lit(""))})
