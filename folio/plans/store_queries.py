"""Queries over what the library keeps between runs: the trigram index, digest tables, the snapshot store, fetched answers."""

from __future__ import annotations

import http.server
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as fx
from folio.operators.diff import diff_digests, save_digests
from folio.operators.index import index_chunks
from folio.operators.postings import search_index, write_index
from folio.plans.built_queries import shared_folder
from folio.plans.queries import _DIFF_SQL, INDEX_SQL, PARAGRAPHS_SQL, TEXT_CHUNKS_SQL, URL_SQL, _hit, _versions, all_chunks, null, query, run_ts, sql_norm, sql_slug, table, text_documents, text_entries
from folio.sources import snapshot_store
from folio.sources.documents import read_documents, write_documents, write_files
from folio.sources.fetching import fetch_all
from folio.sources.snapshots import fetch, snapshot_rows, to_fetch


# Index.
@query(f"SELECT chunk_id, doc_id, text_hash FROM ({INDEX_SQL}) WHERE {_hit('The TION')}")
def query_indexed(spark, sf_dir):
    """As ``query_term``, from lists of trigrams."""
    folder = shared_folder(spark)
    write_index(index_chunks(all_chunks(spark, sf_dir)), folder)
    return search_index(spark, folder, "The TION").select("chunk_id", "doc_id", "text_hash")


# Diff.
@query(
    _DIFF_SQL
    + "SELECT 'https://c.example/' || conv_id AS url, array_to_string(list('t' || turn ORDER BY turn) FILTER (WHERE kind = 'added'), ',') AS added, array_to_string(list('t' || turn ORDER BY turn) FILTER (WHERE kind = 'removed'), ',') AS removed, "
    "array_to_string(list('t' || turn ORDER BY turn) FILTER (WHERE kind = 'changed'), ',') AS changed FROM u JOIN f USING (conv_id) GROUP BY conv_id"
)
def diff_bucketed(spark, sf_dir):
    """Two versions kept as tables of digests, bucketed by URL, compared without a shuffle."""
    folder, name = shared_folder(spark), uuid.uuid4().hex
    sides = []
    for side, docs in zip(("old", "new"), _versions(spark, sf_dir), strict=True):
        save_digests(docs, f"digests_{side}_{name}", f"{folder}/{side}", buckets=16)
        sides.append(spark.table(f"digests_{side}_{name}"))
    out = diff_digests(*sides)
    return out.select("url", *[F.nullif(F.array_join(n, ","), F.lit("")).alias(n) for n in ("added", "removed", "changed")])


# Folders of JSON.
@query(f"SELECT {sql_slug('url')} AS doc, url, block_id, sha256(text) AS text_hash FROM ({TEXT_CHUNKS_SQL}) WHERE seq % 3 = 0")
def json_mixed(spark, sf_dir):
    """The documents in a folder where arrays, numbers, texts and objects with foreign ``sections`` lie too, one file a row of ``documents``."""
    folder = shared_folder(spark)
    docs = text_documents(spark, sf_dir)
    write_documents(docs.where("doc_seq % 3 = 0"), folder, "json")
    body = F.to_json(F.struct("doc_seq", "title"))
    foreign = F.element_at(F.array(F.concat(F.lit("["), body, F.lit("]")), F.col("doc_seq").cast("string"), F.to_json(F.struct("title", F.lit("none").alias("sections"))), F.lit('{"sections": [1, 2]}'), F.lit("null")), (F.col("doc_seq") % 5 + 1).cast("int"))
    write_files(docs.where("doc_seq % 3 <> 0").select(F.concat(F.lit(f"{folder}/other/"), F.col("doc_seq").cast("string"), F.lit(".json")).alias("path"), foreign.alias("text")))
    rows = read_documents(spark, folder, "json").select("url", F.explode_outer("sections").alias("s")).select("url", F.explode_outer("s.blocks").alias("b")).where("b is not null")
    return rows.select(fx.document_id(F.col("url")).alias("doc"), "url", F.col("b.id").alias("block_id"), F.sha2("b.text", 256).alias("text_hash"))


# Families and table functions.
@query(
    "SELECT c_custkey, kind, CASE kind WHEN 'asked' THEN 'rfc' WHEN 'other' THEN 'generic' ELSE c_name END AS family, CASE kind WHEN 'asked' THEN 'normative' WHEN 'other' THEN 'informative' ELSE lower(c_mktsegment) END AS authority, "
    "CASE kind WHEN 'whole' THEN 'text' WHEN 'end' THEN 'text' ELSE 'html' END AS extractor FROM customer, (VALUES ('whole'), ('end'), ('asked'), ('other')) t(kind)"
)
def families_from_table(spark, sf_dir):
    """A family a customer, beside the known ones, for hosts of its name and below it, found by one join."""
    from folio.functions.families import FAMILIES, TABLE, with_family_table

    rows = table(spark, sf_dir, "customer")
    host = F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")), F.lit(".example"))
    own = rows.select(
        F.col("c_name").alias("family"), (F.col("c_custkey") + 100).alias("priority"), F.array(host).alias("hosts"), F.array(F.concat(F.lit("."), host)).alias("suffixes"), F.lower("c_mktsegment").alias("default_authority"),
        null().alias("document_type"), F.lit("text").alias("default_extractor"),
    )
    known = spark.createDataFrame([(f.id, i, list(f.hosts), list(f.suffixes), f.authority, f.document_type, f.extractor) for i, f in enumerate(FAMILIES)], TABLE)
    kinds = {"whole": (host, null()), "end": (F.concat(F.lit("a.b."), host), null()), "asked": (host, F.lit("rfc")), "other": (F.concat(F.lit("x"), host), F.lit("nobody"))}
    entries = None
    for kind, (name, asked) in kinds.items():
        part = rows.select("c_custkey", F.lit(kind).alias("kind"), F.concat(F.lit("https://"), name, F.lit("/p")).alias("url"), asked.alias("family"), null().alias("authority"), null().alias("extractor"))
        entries = part if entries is None else entries.unionByName(part)
    return with_family_table(entries, own.unionByName(known)).select("c_custkey", "kind", "family", "authority", "extractor")


@query("SELECT doc_id, i AS pos, substr(text, i * 1000 + 1, 1000) AS part FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS i FROM documents)")
def windows_in_sql(spark, sf_dir):
    """Windows of texts by a table function, joined laterally in SQL."""
    from folio.functions.table_functions import register

    register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("folio_documents")
    return spark.sql("SELECT d.doc_id, CAST(w.pos AS bigint) AS pos, w.part FROM folio_documents d, LATERAL chunk_windows(d.text, 1000) w")


@query(f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, text FROM (SELECT page_id, unnest(range(1, len(ps) + 1)) AS pos, unnest(ps) AS text FROM (SELECT page_id, {PARAGRAPHS_SQL} AS ps FROM pages))")
def paragraphs_in_sql(spark, sf_dir):
    """Paragraphs of pages' articles by a table function, joined laterally in SQL."""
    from folio.functions.table_functions import register

    register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("folio_pages")
    return spark.sql(
        "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pre) AS pos, text FROM (SELECT p.page_id, e.pre, e.text FROM folio_pages p, LATERAL page_elements(p.html, 'p') e) "
        "JOIN (SELECT p.page_id, min(e.pre) AS root FROM folio_pages p, LATERAL page_elements(p.html, 'article') e GROUP BY p.page_id) USING (page_id) WHERE pre > root AND text <> ''"
    ).selectExpr("page_id", "CAST(pos AS bigint) AS pos", "text")


# Snapshots.
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as fetched versions of one page per user: the page is the kind of event."""
    rows = table(spark, sf_dir, "events")
    url = F.concat(F.lit("https://u.example/"), F.col("user_id").cast("string"))
    return rows.select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("snapshot_id"), url.alias("source_url"), url.alias("final_url"), F.lit("text/plain").alias("content_type"), null().alias("charset"),
        F.octet_length("event_type").cast("long").alias("bytes"), F.sha2("event_type", 256).alias("sha256"), F.col("ts").cast("timestamp").alias("fetched_at"), F.lit("content.txt").alias("file_name"),
        F.lit(False).alias("manual"), null().alias("manual_source_path"), F.encode("event_type", "UTF-8").alias("content"), "event_id",
    )


@query(
    "SELECT url, latest, history, content, n_contents FROM (SELECT 'https://u.example/' || user_id AS url, arg_max(sha256(event_id::VARCHAR), (ts, sha256(event_id::VARCHAR))) AS latest, "
    "sha256(array_to_string(list(sha256(event_id::VARCHAR) ORDER BY ts, sha256(event_id::VARCHAR)), ',')) AS history, arg_max(event_type, (ts, sha256(event_id::VARCHAR))) AS content FROM events GROUP BY user_id), "
    "(SELECT count(DISTINCT event_type) AS n_contents FROM events)"
)
def snapshot_upsert(spark, sf_dir):
    """Versions added to the store in three upserts, one of them twice; every content is kept once."""
    folder, rows = shared_folder(spark), _events(spark, sf_dir)
    for part in (0, 1, 1, 2):
        snapshot_store.upsert(spark, folder, rows.where(F.col("event_id") % 3 == part))
    index = snapshot_store.index_of(spark, folder).select("url", "latest", F.sha2(F.array_join("history", ","), 256).alias("history"))
    manifest = index.select("url", F.col("latest").alias("wanted"))
    bytes_of = snapshot_store.with_latest(manifest, folder).select("url", F.decode("content", "UTF-8").alias("content"))
    n = snapshot_store.stored(spark, folder, "contents").agg(F.count("*").alias("n_contents"))
    # One row of a count.
    return index.join(bytes_of, "url").join(F.broadcast(n), F.lit(True)).select("url", "latest", "history", "content", "n_contents")


class Answers(http.server.BaseHTTPRequestHandler):
    """Answers that follow from the path alone: some move, some fail, some name no type."""

    def do_GET(self):
        number = int(self.path.split("/")[-1].split("?")[0])
        if number % 5 == 4 and "moved" not in self.path:
            self.send_response(302)
            self.send_header("Location", f"/moved/{number}")
            self.end_headers()
            return
        self.send_response(404 if number % 7 == 3 else 200)
        if number % 2:
            self.send_header("Content-Type", "text/plain; charset=ISO-8859-1")
        body = f"page {number}".encode()
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@contextmanager
def serving(spark: SparkSession, handler=Answers):
    """The address of a server on the driver's own host, for as long as the block runs."""
    host = spark.sparkContext.getConf().get("spark.driver.host", "127.0.0.1")
    server = http.server.ThreadingHTTPServer((host, 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://{host}:{server.server_port}"
    finally:
        server.shutdown()
        server.server_close()


@query(
    "SELECT page_id, CASE WHEN page_id % 7 <> 3 THEN '/' || CASE WHEN page_id % 5 = 4 THEN 'moved' ELSE 'p' END || '/' || page_id END AS final_path, CASE WHEN page_id % 7 <> 3 THEN CASE WHEN page_id % 2 = 1 THEN 'text/plain; charset=ISO-8859-1' ELSE 'application/octet-stream' END END AS content_type, "
    "CASE WHEN page_id % 7 <> 3 AND page_id % 2 = 1 THEN 'latin1' END AS charset, CASE WHEN page_id % 7 <> 3 THEN sha256('page ' || page_id) END AS sha256 FROM pages"
)
def fetched_by_host(spark, sf_dir):
    """Every page fetched through the data source, its answers kept in the shared folder and read again after the server is gone."""
    folder = shared_folder(spark)
    with serving(spark) as address:
        urls = table(spark, sf_dir, "pages").select(F.concat(F.lit(f"{address}/p/"), F.col("page_id").cast("string")).alias("url"))
        fetch_all(urls, folder, quarantine=True, retries=0, urls_a_task=100).write.format("noop").mode("overwrite").save()
    # The second pass asks no one: its rows are the answers kept by the first.
    got = fetch_all(urls, folder, quarantine=True, retries=0, urls_a_task=100)
    number = F.regexp_extract("url", "/p/([0-9]+)", 1).cast("long").alias("page_id")
    rows = snapshot_rows(got.where("error is null"), run_ts()).withColumnRenamed("source_url", "url")
    fine = rows.select(number, F.regexp_extract("final_url", "(/[a-z]+/[0-9]+)$", 1).alias("final_path"), "content_type", "charset", "sha256")
    return fine.unionByName(got.where("error is not null").select(number, *[null().alias(c) for c in ("final_path", "content_type", "charset", "sha256")]))




@query(
    "SELECT page_id, '/' || CASE WHEN page_id % 5 = 4 THEN 'moved' ELSE 'p' END || '/' || page_id AS final_path, CASE WHEN page_id % 2 = 1 THEN 'text/plain; charset=ISO-8859-1' ELSE 'application/octet-stream' END AS content_type, "
    "CASE WHEN page_id % 2 = 1 THEN 'latin1' END AS charset, sha256('page ' || page_id) AS sha256, octet_length(encode('page ' || page_id)) AS bytes FROM pages WHERE page_id % 7 <> 3 AND page_id % 4 <> 0 "
    "UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL FROM pages WHERE page_id % 7 = 3 AND page_id % 4 <> 0"
)
def http_snapshots(spark, sf_dir):
    """Pages fetched from a server that this query starts and ends: moved ones followed, failures set apart, known ones left out."""
    folder = shared_folder(spark)
    with serving(spark) as address:
        manifest = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(f"{address}/p/"), F.col("page_id").cast("string"), F.lit("#f")).alias("url"))
        known = manifest.where("page_id % 4 = 0").select(fx.normalize_url(F.col("url")).alias("source_url"))
        fetch(to_fetch(manifest, known, reuse=True), quarantine=True).write.parquet(folder)
    got = spark.read.parquet(folder)
    number = F.regexp_extract("url", "/p/([0-9]+)", 1).cast("long").alias("page_id")
    rows = snapshot_rows(got.where("error is null"), run_ts()).withColumnRenamed("source_url", "url")
    path = F.regexp_extract("final_url", "(/[a-z]+/[0-9]+)$", 1).alias("final_path")
    fine = rows.select(number, path, "content_type", "charset", "sha256", "bytes")
    failed = got.where("error is not null").select(number, *[null().alias(c) for c in ("final_path", "content_type", "charset", "sha256")], F.lit(None).cast("long").alias("bytes"))
    return fine.unionByName(failed)


# Streams with state.
@query(
    f"SELECT {sql_slug(URL_SQL)} AS doc, 'section-1' AS section_id, sha256({sql_norm("CASE WHEN doc_id % 3 = 0 THEN text || ' more' ELSE text END")}) AS hash FROM documents"
)
def streamed_changes(spark, sf_dir):
    """Two versions of every third document, the newer one first, and one of the others: the sections that the streamed changes lead to."""
    from folio.streaming import changes

    folder = shared_folder(spark)
    url = F.concat(F.lit("https://corpus.example/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents")
    rows = lambda text: docs.where("doc_id % 3 = 0").select(url.alias("url"), null().alias("final_url"), F.lit("text/plain").alias("content_type"), F.encode(text, "UTF-8").alias("content"))
    newer = snapshot_rows(rows(F.concat("text", F.lit(" more"))), F.lit("2024-02-01").cast("timestamp"))
    older = snapshot_rows(rows(F.col("text")), run_ts())
    others = snapshot_rows(docs.where("doc_id % 3 <> 0").select(url.alias("url"), null().alias("final_url"), F.lit("text/plain").alias("content_type"), F.encode("text", "UTF-8").alias("content")), run_ts())
    for part in (newer, older.unionByName(others)):
        part.write.mode("append").parquet(f"{folder}/in")
        changes.start_digests(spark, f"{folder}/in", f"{folder}/digests", f"{folder}/check-1", run_ts(), extractor="text").awaitTermination()
        changes.start_changes(spark, f"{folder}/digests", f"{folder}/out", f"{folder}/check-2").awaitTermination()
    return changes.applied(spark.read.parquet(f"{folder}/out")).select(fx.document_id(F.col("url")).alias("doc"), "section_id", "hash")


# Chunks kept up to date.
_ALTERED_SQL = "(SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN text || ' more' ELSE text END AS text FROM documents)"


@query(f"SELECT doc || '::section-1::' || block_id AS chunk_id, sha256(text) AS text_hash FROM ({TEXT_CHUNKS_SQL.replace('FROM documents', f'FROM {_ALTERED_SQL}')})")
def chunks_updated(spark, sf_dir):
    """Half of the documents as files and their chunks, then the other half and an altered tenth: the second update reads these alone."""
    from folio.operators.extract import extract
    from folio.sources import chunk_store

    folder, entries = shared_folder(spark), text_entries(spark, sf_dir)
    altered = F.when(F.col("doc_seq") % 10 == 0, F.encode(F.concat(F.decode("content", "UTF-8"), F.lit(" more")), "UTF-8")).otherwise(F.col("content"))
    for part in (entries.where("doc_seq % 2 = 0"), entries.where("doc_seq % 2 = 1 or doc_seq % 10 = 0").withColumn("content", altered)):
        write_documents(extract(part, run_ts(), extractors=("text",)), f"{folder}/in", "json")
        chunk_store.update(spark, f"{folder}/in", f"{folder}/out")
    return chunk_store.all_chunks(spark, f"{folder}/out").select("chunk_id", F.sha2("text", 256).alias("text_hash"))
