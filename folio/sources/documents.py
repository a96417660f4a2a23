"""Documents, chunks and indexes as JSON and Parquet."""

from __future__ import annotations

import json
import os
import posixpath
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import iso
from folio.operators.extract import output_path
from folio.operators.render import markdown
from folio.operators.schema import BLOCK_FIELDS, SECTION

DOCUMENT_SCHEMA = (
    "schema_version string, url string, title string, family string, authority string, document_type string, snapshot_id string, fragment string, "
    f"extracted_at timestamp, sections array<{SECTION}>, warnings array<string>"
)


#: The contract's form: the same under its own names, ordinals left to the arrays' order.
_PLACE = "source struct<url:string,fragment:string,path:string>"
_CONTRACT_BLOCK = (
    "struct<id:string,type:string,text:string,ordered:boolean,items:array<string>,headers:array<string>,rows:array<array<string>>,title:string,"
    "steps:array<struct<stepId:string,text:string>>,productions:array<struct<lhs:string,rhs:string>>,normativity:string,"
    f"links:array<struct<text:string,href:string,resolvedId:string>>,{_PLACE.replace(' ', ':', 1)}>"
)
CONTRACT_SCHEMA = (
    "schemaVersion string, url string, title string, family string, authority string, documentType string, snapshotId string, fragment string, extractedAt string, "
    f"sections array<struct<id:string,heading:string,level:int,{_PLACE.replace(' ', ':', 1)},blocks:array<{_CONTRACT_BLOCK}>>>, warnings array<string>"
)


def write_documents(docs: DataFrame, path: str, fmt: str = "parquet", trimmed: bool = True) -> None:
    """Documents as Parquet by family, or as one file each (``json`` or ``md``, ``trimmed`` or not) at its :func:`output_path` below ``path``."""
    if fmt == "parquet":
        docs.write.mode("overwrite").partitionBy("family").parquet(path)
        return
    own = F.col("output") if "output" in docs.columns else F.lit(None).cast("string")
    placed = docs.withColumn("path", output_path(own, F.col("family"), F.col("url"), path, fmt))
    texts = markdown(placed, trimmed).select("path", F.col("markdown").alias("text")) if fmt == "md" else contract_json(placed, pretty=False).select("path", F.col("json").alias("text"))
    write_files(texts, indent=fmt == "json")


def write_files(texts: DataFrame, indent: bool = False) -> None:
    """Each ``text`` to its ``path``, by the tasks; ``indent`` lays JSON out over lines.

    A path is a URI that Arrow's file systems know, or a folder that all executors
    share.  A file appears under its name only when it is whole, so a task that is
    run again replaces what it wrote before.
    """

    def put(rows):
        from pyarrow import fs

        for row in rows:
            store, path = fs.FileSystem.from_uri(row["path"]) if "://" in row["path"] else (fs.LocalFileSystem(), row["path"])
            text = json.dumps(json.loads(row["text"]), indent=2, ensure_ascii=False) + "\n" if indent else row["text"]
            store.create_dir(posixpath.dirname(path) or ".", recursive=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                out.write(text.encode())
            store.move(part, path)

    texts.select("path", "text").foreachPartition(put)


def listed_files(spark: SparkSession, path: str, suffix: str, tasks: int = 16) -> DataFrame:
    """``file``, ``size`` and ``modified`` of the files below a folder, listed by tasks: no list of them is held as a whole.

    The folder is one that Arrow's file systems know, as for :func:`write_files`;
    ``file`` is a path there.
    """

    def children(store, folder):
        from pyarrow import fs

        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(folder) as entries:
                for e in entries:
                    if e.is_dir():
                        yield e.path, None, None
                    elif e.name.endswith(suffix):
                        at = e.stat()
                        yield e.path, at.st_size, at.st_mtime_ns // 1000
            return
        for e in store.get_file_info(fs.FileSelector(folder)):
            if e.type == fs.FileType.Directory:
                yield e.path, None, None
            elif e.base_name.endswith(suffix):
                yield e.path, e.size, (e.mtime_ns or 0) // 1000

    def list_once(deep):
        def run(batches):
            rows = []
            for batch in batches:
                for row in zip(*batch.to_pydict().values(), strict=True):
                    open_ = [row]
                    while open_:
                        file, size, modified = open_.pop()
                        if size is not None:
                            found = [(file, size, modified)]
                        else:
                            found = children(opened(path)[0], file)
                        for one in found:
                            if deep and one[1] is None:
                                open_.append(one)
                                continue
                            rows.append(one)
                            if len(rows) == LISTED:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LISTED, strict=True)], list("fsm"))
                                rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LISTED, strict=True)], list("fsm"))

        return run

    root = spark.createDataFrame([(opened(path)[1].rstrip("/"), None, None)], "f string, s long, m long")
    # What stands in the folder itself is dealt, folders are listed to any depth where they go.
    top = root.mapInArrow(list_once(False), root.schema).repartition(tasks, "f").mapInArrow(list_once(True), root.schema)
    return top.select(F.col("f").alias("file"), F.col("s").alias("size"), F.timestamp_micros("m").alias("modified"))


def dealt_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """The files of :func:`listed_files`, dealt over a set number of tasks: their names are few bytes, and what they name is many."""
    return listed_files(spark, path, suffix).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")


def file_texts(files: DataFrame, path: str, binary: bool = False) -> DataFrame:
    """``file`` and ``value``, the text, or the bytes, of each of the ``files`` below ``path``, read by the tasks one after the other."""
    kind = pa.binary() if binary else pa.string()

    def run(batches):
        store = opened(path)[0]
        for batch in batches:
            names, texts, size = [], [], 0
            for file in batch.column(0).to_pylist():
                with store.open_input_stream(file) as stream:
                    texts.append(stream.read() if binary else stream.read().decode("utf-8", "replace"))
                names.append(file)
                size += len(texts[-1])
                if size >= TEXTS:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts, kind)], ["file", "value"])
                    names, texts, size = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts, kind)], ["file", "value"])

    return files.select("file").mapInArrow(run, f"file string, value {'binary' if binary else 'string'}")


#: Rows of a batch of names, and characters or bytes from which on a batch of texts is full.
LISTED, TEXTS = 1 << 12, 1 << 20
_LISTED = (pa.string(), pa.int64(), pa.int64())


def opened(path: str):
    """Arrow's file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def is_folder(path: str) -> bool:
    """Whether Arrow's file systems know a path or URI as a folder."""
    from pyarrow import fs

    try:
        store, place = opened(path)
        return store.get_file_info(place).type == fs.FileType.Directory
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def read_documents(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Documents of a folder, searched to any depth, or of a list of files, which are then named in ``file``.

    JSON values without sections are no documents, malformed JSON is an error.
    """
    named = not isinstance(path, str)
    if fmt == "json":
        return _from_contract(read_json_documents(spark, path, named), ["file"] if named else [])
    read = spark.read.parquet(*path) if named else spark.read.parquet(path)
    file = [F.col("_metadata.file_path").alias("file")] if named else []
    return read.select(*[F.col(c) for c in spark.createDataFrame([], DOCUMENT_SCHEMA).columns], *file)


def read_json_documents(spark: SparkSession, path: str | list[str], named: bool = False) -> DataFrame:
    """The documents among a folder's JSON files, whatever else lies there, under the contract's names.

    Each file is read as a VARIANT: an object with an array of sections is a
    document, other objects, arrays and plain values are not.  Of a document that
    has a field of another type that field is null.  A malformed file ends the run.

    Files of a folder are listed and read by the tasks, hidden ones too; the driver
    holds no list of them.  A single file, a pattern, a list and a folder in a store
    that Arrow doesn't know go through Spark's own reader, which lists on the driver.
    """
    if not named and is_folder(path):
        return _json_documents(file_texts(dealt_files(spark, path, ".json"), path), False)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return _json_documents(files.select("value", F.col("_metadata.file_path").alias("file")) if named else files, named)


def read_listed(files: DataFrame, path: str) -> DataFrame:
    """The documents in the JSON ``files`` of a folder, named in ``file``; the names stay with the tasks."""
    return _from_contract(_json_documents(file_texts(files, path), True), ["file"])


def _json_documents(files: DataFrame, named: bool) -> DataFrame:
    # A file of white space alone is no JSON; anything that can't be parsed is an error here.
    value = F.parse_json("value").alias("v")
    documents = files.select(value, *(["file"] if named else [])).where("coalesce(schema_of_variant(try_variant_get(v, '$.sections', 'variant')), '') LIKE 'ARRAY%'")
    fields = [f.strip().split(" ", 1) for f in _fields(CONTRACT_SCHEMA)]
    # What isn't an array of sections after all, but of other values, is no document either.
    return documents.select(*[F.try_variant_get("v", f"$.{name}", kind).alias(name) for name, kind in fields], *(["file"] if named else [])).where("not exists(sections, s -> s is null)")


def _fields(schema: str) -> list[str]:
    """The fields of a schema in DDL, cut at commas outside of brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _from_contract(read: DataFrame, more: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Documents in the contract's form under the names and types of :data:`DOCUMENT_SCHEMA`."""
    pair = "struct<term:string,definition:string>"

    def block(b, i):
        is_pairs = b["type"] == "definitionList"
        plain = {n: b[n] for n in ("id", "type", "text", "ordered", "headers", "rows", "title", "productions", "normativity", "source")}
        made = plain | {
            "ordinal": i, "items": F.when(~is_pairs, b["items"]), "definitions": F.when(is_pairs, F.transform(b["items"], lambda x: F.from_json(x, pair))),
            "steps": F.transform(b["steps"], lambda s: F.struct(s["stepId"].alias("step_id"), s["text"].alias("text"))),
            "links": F.transform(b["links"], lambda x: F.struct(x["text"].alias("text"), x["href"].alias("href"), x["resolvedId"].alias("resolved_id"))),
        }
        return F.struct(*[made[n].alias(n) for n in BLOCK_FIELDS])

    section = lambda s, i: F.struct(i.alias("ordinal"), s["id"].alias("id"), s["heading"].alias("heading"), s["level"].alias("level"), s["source"].alias("source"), F.transform(s["blocks"], block).alias("blocks"))
    return read.select(
        F.col("schemaVersion").alias("schema_version"), "url", "title", "family", "authority", F.col("documentType").alias("document_type"), F.col("snapshotId").alias("snapshot_id"), "fragment",
        F.to_timestamp("extractedAt").alias("extracted_at"), F.transform("sections", section).cast(f"array<{SECTION}>").alias("sections"), "warnings", *more,
    )


def breaks_contract() -> Column:
    """Whether a required field is null, of a document, a section or a block."""
    required = [F.col(c).isNull() for c in ("schema_version", "url", "title", "family", "sections", "extracted_at")]
    bad = F.lit(False)
    for test in required:
        bad = bad | test
    section = F.exists("sections", lambda s: s["heading"].isNull() | s["level"].isNull() | s["blocks"].isNull() | F.exists(s["blocks"], lambda b: b["type"].isNull()))
    return F.coalesce(bad | section, F.lit(False))


def invalid_documents(docs: DataFrame) -> DataFrame:
    """Documents that break the contract."""
    return docs.where(breaks_contract())


def contract_json(docs: DataFrame, pretty: bool = True) -> DataFrame:
    """``url``, ``path`` (if the documents have one) and ``json``: documents under the contract's names, null fields left out, definitions as the items of their lists."""
    rename = lambda d: F.struct(d["text"].alias("text"), d["href"].alias("href"), d["resolved_id"].alias("resolvedId"))

    def block(b):
        items = F.when(b["type"] == "definitionList", F.to_json(b["definitions"])).otherwise(F.to_json(b["items"]))
        steps = F.transform(b["steps"], lambda s: F.struct(s["step_id"].alias("stepId"), s["text"].alias("text")))
        plain = [b[n].alias(n) for n in ("id", "type", "text", "ordered", "headers", "rows", "title", "productions", "normativity", "source")]
        return F.struct(*plain, F.parse_json(items).alias("items"), steps.alias("steps"), F.transform(b["links"], rename).alias("links"))

    section = lambda s: F.struct(*[s[n].alias(n) for n in ("id", "heading", "level", "source")], F.transform(s["blocks"], block).alias("blocks"))
    whole = F.struct(
        F.col("schema_version").alias("schemaVersion"), "url", "title", "family", "authority", F.col("document_type").alias("documentType"), F.col("snapshot_id").alias("snapshotId"),
        "fragment", iso(F.col("extracted_at")).alias("extractedAt"), F.transform("sections", section).alias("sections"), "warnings",
    )
    return docs.select("url", *[c for c in ("path",) if c in docs.columns], F.to_json(whole, {"pretty": str(pretty).lower()}).alias("json"))


#: The contract's names of columns of chunks and of the index.
_NAMES = {
    "chunk_id": "chunkId", "doc_id": "docId", "section_id": "sectionId", "block_id": "blockId", "block_type": "blockType", "snapshot_id": "snapshotId", "extracted_at": "extractedAt",
    "text_hash": "textHash", "text_preview": "textPreview",
}
_KEEP_NULLS = {"ignoreNullFields": "false"}


def chunk_json(chunked: DataFrame, folder: str) -> DataFrame:
    """``path`` below ``folder`` and ``text``: chunks as JSON under the contract's names; of chunks with one path the last."""
    link = lambda d: F.struct(d["text"].alias("text"), d["href"].alias("href"), d["resolved_id"].alias("resolvedId"))
    made = {"links": F.transform("links", link), "extracted_at": iso(F.col("extracted_at"))}
    names = ("chunk_id", "doc_id", "url", "fragment", "family", "authority", "section_id", "block_id", "block_type", "heading", "level", "text", "source", "links", "snapshot_id", "extracted_at", "normativity")
    text = F.to_json(F.struct(*[made.get(c, F.col(c)).alias(_NAMES.get(c, c)) for c in names]), _KEEP_NULLS)
    order = F.struct("doc_order", "section_ordinal", "block_ordinal")
    last = chunked.select("path", text.alias("text"), order.alias("o")).groupBy("path").agg(F.max_by("text", "o").alias("text"))
    return last.select(F.concat(F.lit(f"{folder}/"), "path").alias("path"), "text")


def index_json(index: DataFrame) -> DataFrame:
    """``json``: entries of the index under the contract's names."""
    names = ("chunk_id", "doc_id", "family", "heading", "section_id", "block_id", "url", "fragment", "path", "text_hash", "normativity", "block_type", "text_preview")
    return index.select(F.to_json(F.struct(*[F.col(c).alias(_NAMES.get(c, c)) for c in names]), _KEEP_NULLS).alias("json"))
