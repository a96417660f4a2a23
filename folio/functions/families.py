"""Families: which rules hold for the pages of a host, as data and as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import falsy, host_of


@dataclass(frozen=True)
class Family:
    """``hosts`` are whole names, ``suffixes`` ends of names; the first family that matches holds."""

    id: str
    hosts: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    authority: str = "informative"
    document_type: str | None = None
    root: str = "main, article, body"
    sections: str | None = None
    single_pre: bool = False
    prune: tuple[str, ...] = ()
    rules: dict = field(default_factory=dict, hash=False)
    extractor: str = "html"

    def html_rules(self) -> dict:
        return {"root": self.root, "sections": self.sections, "single_pre": self.single_pre, "prune": ["nav", "header", "footer", *self.prune], **self.rules}


#: Selectors and classes that two families set themselves.
_GRAMMAR = ["pre.grammar", "pre.bnf", "pre.idl", "pre.webidl", "emu-grammar"]
_W3C = {
    "algorithm": ["ol.algorithm", "div.algorithm > ol", ".algorithm", "emu-alg"],
    "grammar": _GRAMMAR,
    "informative": ["note", "non-normative", "informative", "warning", "issue", "example"],
    "example": ["example"],
    "normative": ["normative"],
}
_WHATWG = {
    "algorithm": ["ol.algorithm", ".algorithm > ol", "emu-alg"],
    "grammar": _GRAMMAR,
    "informative": ["note", "non-normative", "informative", "warning", "advisement", "example"],
    "example": ["example"],
    "normative": ["normative"],
}
_PAPER = {"document_type": "paper"}
_MDN = ("#sidebar-quicklinks", ".toc", ".sidebar", ".document-toc", ".article-actions", ".article-actions-container", ".document-actions", ".document-contributors", ".language-menu", ".breadcrumbs")

#: The known families, by id; the last one takes what no other takes.
FAMILIES = (
    Family("arxiv", ("arxiv.org", "www.arxiv.org"), prune=(".metatable", ".extra-services"), **_PAPER),
    Family("core", ("core.ac.uk",), (".core.ac.uk",), prune=(".sidebar", ".breadcrumbs"), **_PAPER),
    Family("designtokens", ("designtokens.org", "www.designtokens.org"), root="main, body", sections="main section, section", prune=("#toc", ".toc", ".head", ".index")),
    Family("github", ("github.com",), root="article.markdown-body, .markdown-body, main", prune=(".gh-header", ".js-sticky", ".toc")),
    Family("lingbuzz", ("lingbuzz.com",), (".lingbuzz.com",), prune=(".sidebar",), **_PAPER),
    Family("mdn", ("developer.mozilla.org",), root="article, main, body", prune=_MDN),
    Family("philsci", ("philsci-archive.pitt.edu",), prune=(".sidebar",), **_PAPER),
    Family("premis", ("www.loc.gov", "loc.gov", "id.loc.gov"), authority="normative", root="main, body", prune=(".toc", ".breadcrumbs")),
    Family("rfc", ("www.rfc-editor.org", "rfc-editor.org"), authority="normative", root="main, body", single_pre=True),
    Family("ssrn", ("ssrn.com",), (".ssrn.com",), prune=(".sidebar", ".social"), **_PAPER),
    Family("tc39", ("tc39.es",), authority="normative", root="body", sections="emu-intro, emu-clause, emu-annex", prune=("#toc", ".toc")),
    Family("unicode", suffixes=("unicode.org",), authority="normative", root="body", prune=("#toc", ".toc", ".navbar", ".nav", "table.header", "#header")),
    Family("w3c", ("www.w3.org", "w3.org"), authority="normative", root="main, body", sections="main section, section", prune=("#toc", ".toc", ".head", ".index", ".breadcrumbs"), rules=_W3C),
    Family("webcomponents", ("webcomponents.dev", "custom-elements-manifest.open-wc.org", "open-wc.org"), prune=(".toc", ".sidebar", ".breadcrumbs")),
    Family("webdev", ("web.dev",), root="article, main, body", prune=(".toc", ".toc-container", ".webdev-footer", ".webdev-footer-secondary", ".article-actions", ".cta")),
    Family("whatwg", suffixes=("whatwg.org",), authority="normative", root="main", sections="main section", prune=("#toc", ".toc", ".sidebar", ".nav", ".back-matter", ".notes"), rules=_WHATWG),
    Family("generic", root="main, body", sections="section", prune=("#toc", ".toc")),
)
BY_ID = {f.id: f for f in FAMILIES}


def families_of(rows: list[dict]) -> tuple[Family, ...]:
    """Families from plain data (the fields of :class:`Family`); rows without an id are left out, ``generic`` is added last if it is missing."""
    lists = ("hosts", "suffixes", "prune")
    made = [Family(**{k: tuple(v) if k in lists else v for k, v in row.items()}) for row in rows if row.get("id")]
    return tuple(made) if any(f.id == "generic" for f in made) else (*made, BY_ID["generic"])


def resolve_family(url: Column, explicit: Column | None = None, families=FAMILIES) -> Column:
    """The id of the family that is asked for if it is known, else of the first that the host matches, else ``generic``."""
    host = F.coalesce(host_of(url), F.lit(""))
    out = F.lit("generic")
    for family in reversed([f for f in families if f.id != "generic"]):
        test = host.isin(*family.hosts) if family.hosts else F.lit(False)
        for suffix in family.suffixes:
            test = test | host.endswith(suffix)
        out = F.when(test, family.id).otherwise(out)
    if explicit is not None:
        out = F.when(explicit.isin(*[f.id for f in families]), explicit).otherwise(out)
    return out


def families_table(spark: SparkSession, families=FAMILIES) -> DataFrame:
    """The dimension table: ``family``, ``default_authority``, ``document_type``, ``default_extractor``; of families with one id the first holds."""
    rows = [(f.id, f.authority, f.document_type, f.extractor) for f in {f.id: f for f in reversed(families)}.values()]
    return spark.createDataFrame(rows, "family string, default_authority string, document_type string, default_extractor string")


#: A table of families: in order of ``priority`` the first that matches holds.
TABLE = "family string, priority long, hosts array<string>, suffixes array<string>, default_authority string, document_type string, default_extractor string"


def rules_of(families: DataFrame) -> DataFrame:
    """``family``, ``priority``, ``pattern`` and whether it is a ``whole`` host name: one row a name or end of names of a table of families."""
    each = lambda column, whole: families.select("family", "priority", F.explode(column).alias("pattern"), F.lit(whole).alias("whole"))
    return each("hosts", True).unionByName(each("suffixes", False))


def families_of_hosts(hosts: DataFrame, families: DataFrame) -> DataFrame:
    """``host`` and ``family`` of the distinct ``host``s that a family of the table matches.

    A host is looked up whole and by its ends, as many as there are lengths of
    ends in the table: an equi join, whatever the number of families.
    """
    rules = rules_of(families)
    # At most as many lengths as a host name has characters.
    lengths = sorted(r[0] for r in rules.where(~F.col("whole")).select(F.length("pattern")).distinct().collect())
    ends = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.when(F.length("host") >= n, F.right("host", n))), lambda x: x.isNotNull())
    key = lambda x, whole: F.struct(x.alias("pattern"), F.lit(whole).alias("whole"))
    keys = F.concat(F.array(key(F.col("host"), True)), F.transform(ends, lambda x: key(x, False)))
    looked_up = hosts.select("host").distinct().select("host", F.explode(keys).alias("k")).select("host", "k.pattern", "k.whole")
    return looked_up.join(rules, ["pattern", "whole"]).groupBy("host").agg(F.min_by("family", "priority").alias("family"))


def with_family_table(entries: DataFrame, families: DataFrame) -> DataFrame:
    """As :func:`with_family`, of families in a table of any size (:data:`TABLE`); of families with one id the one of least priority number holds."""
    known = families.groupBy("family").agg(*[F.min_by(c, "priority").alias(c) for c in ("default_authority", "document_type", "default_extractor")])
    rows = entries.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    found = families_of_hosts(rows.select("host"), families).withColumnRenamed("family", "by_host")
    asked = known.select(F.col("family").alias("by_name"))
    rows = rows.join(found, "host", "left").join(asked, rows["family"] == F.col("by_name"), "left")
    return _described(rows.withColumn("family", F.coalesce("by_name", "by_host", F.lit("generic"))), known, entries.columns, "left")


def with_family(entries: DataFrame, families=FAMILIES) -> DataFrame:
    """Adds to manifest entries the resolved ``family``, ``authority``, ``extractor`` and ``document_type``; an entry's own values hold first."""
    known = F.broadcast(families_table(entries.sparkSession, families))  # one row a family
    return _described(entries.withColumn("family", resolve_family(F.col("url"), F.col("family"), families)), known, entries.columns)


def _described(own: DataFrame, known: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    return own.join(known, "family", how).select(
        *[c for c in columns if c not in ("authority", "extractor")],
        F.coalesce(falsy(F.col("authority")), "default_authority", F.lit("informative")).alias("authority"),
        F.coalesce(falsy(F.col("extractor")), "default_extractor", F.lit("html")).alias("extractor"),
        "document_type",
    )
