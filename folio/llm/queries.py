"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import binary_records, byte_bpe, decontaminate, katz_lm, license_scan, line_templates, neighbour_vote, periodic_runs, prob_minhash, quality_cascade, recompression, run_length_index, source_divergence
from folio.llm.common import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(coded, ranks, public_tokenizers.PATTERN)


def _checksum(doc_id, start, ids):
    return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "records")
    # About 10 MB of text a file.
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    binary_records.write_records(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408, partitions=max(1, round(size / 10e6)))
    return binary_records.map_records(spark, folder, _checksum, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.quality(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompression.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_length_index.remove_long_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    # The whole model and its tables, though they take more disk than the check tool allows; see README.
    out = katz_lm.scores(table(spark, sf_dir, "documents"), ~held_out, tables=scratch(spark, "katz"))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op12_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = neighbour_vote.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def _words_again(batches):
    """Every tenth document, by a hash of its id, as the contract has it: its words repeat from one of them on."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        changed = {}
        for i, doc_id in enumerate(ids):
            h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
            if h % 10 == 0:
                words = periodic_runs.tokens(texts.slice(i, 1))[0].to_pylist()
                if n := len(words):
                    g = h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    changed[i] = " ".join(words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a])
        if changed:
            texts = pa.array([changed.get(i, x) for i, x in enumerate(texts.to_pylist())], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_words_again, "doc_id bigint, text string")
    out = periodic_runs.periodic_runs(docs)
    # The greatest length, then the smallest start, then the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"), "n_words",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_byte_bpe, op3_binary_records, op4_line_templates, op5_quality_cascade, op6_decontaminate, op7_recompression, op8_run_length_index, op9_katz_lm, op10_prob_minhash, op11_source_divergence, op12_neighbour_vote, op13_periodic_runs)
}


def _line_sql(line: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({line}), '{license_scan.NOT_A_WORD}', ' ', 'g'), ' {{2,}}', ' ', 'g'))"


def _spelled_sql(words: str) -> str:
    wide = lambda x: f" {x.replace(' ', '  ')} "
    x = f"' ' || replace({words}, ' ', '  ') || ' '"
    for other, one in license_scan.SPELLINGS:
        x = f"replace({x}, '{wide(other)}', '{wide(one)}')"
    return f"trim(replace({x}, '  ', ' '))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL: dict[str, str] = {
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
keep AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM keep GROUP BY 1),
g AS (SELECT lang, source, (SELECT count(*) FROM w JOIN keep USING (lang, term) WHERE w.lang = x.lang AND w.source = x.source) AS total FROM (SELECT DISTINCT lang, source FROM d) x),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3),
p AS (SELECT g.lang, g.source, keep.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v) AS p, 1 + 1000000000 * (keep.n + 2) // (l.total + 2 * l.v) AS q
  FROM g JOIN l ON g.lang = l.lang JOIN keep ON keep.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = keep.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
both_parts AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
""",
    "op7_recompression": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(doc_id, -9223372036854775808) AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT id, doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
grams AS (SELECT id, doc_id, i, lead(i, 12) OVER o AS stop, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o,
  lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o, lead(word, 8) OVER o, lead(word, 9) OVER o, lead(word, 10) OVER o, lead(word, 11) OVER o,
  lead(word, 12) OVER o) AS gram FROM x WINDOW o AS (PARTITION BY id ORDER BY i)),
hit AS (SELECT id, i FROM (SELECT id, doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS least FROM grams WHERE stop IS NOT NULL) WHERE doc_id > least),
gone AS (SELECT DISTINCT id, i + unnest(range(13)) AS i FROM hit),
kept AS (SELECT id, count(gone.i) AS n_removed, list(word ORDER BY x.i) FILTER (WHERE gone.i IS NULL) AS ks FROM x LEFT JOIN gone USING (id, i) GROUP BY id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(array_to_string(coalesce(ks, []), ' ')) AS kept_sha256 FROM d LEFT JOIN kept USING (id)
""",
    "op1_license_scan": f"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, NULL AS license FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, body, name FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in license_scan.KNOWN)}) v(name, body)),
starts AS (
  SELECT *, regexp_matches(l, '{license_scan.COPYRIGHT_LINE}') AND NOT regexp_matches(l, '{license_scan.NOT_A_COPYRIGHT_LINE}') AS start
  FROM (SELECT id, doc_id, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS pos FROM texts)),
line AS (
  SELECT id, doc_id, pos, {_line_sql('l')} AS words, start OR coalesce(lag(start AND regexp_matches(l, '{license_scan.GOES_ON}')) OVER (PARTITION BY id ORDER BY pos), false) AS statement FROM starts),
entire AS (SELECT id, {_spelled_sql("string_agg(words, ' ' ORDER BY pos)")} AS c FROM line WHERE words <> '' GROUP BY id),
whole AS (
  SELECT id, {_spelled_sql("string_agg(words, ' ' ORDER BY pos)")} AS c FROM line
  WHERE words <> '' AND NOT statement AND words NOT IN ({', '.join(map(_quoted, license_scan.TITLES))}) GROUP BY id),
known AS (
  SELECT digest, min(name) AS license FROM (
    SELECT sha256(c) AS digest, license AS name FROM texts JOIN whole USING (id) WHERE id < 0
    UNION ALL SELECT digest, name FROM (VALUES {', '.join(f"('{name}', '{digest}')" for name, _, digest in license_scan.KNOWN_DIGESTS)}) v(name, digest)) GROUP BY digest),
found AS (
  SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license)), ',') AS names
  FROM line JOIN known ON digest = sha256({_spelled_sql('words')}) WHERE id > 0 AND words <> '' AND NOT statement GROUP BY doc_id)
SELECT d.doc_id, sha256(w.c) AS text_digest, coalesce(k.license, ke.license) AS license, coalesce(f.n, 0) AS n_notices, coalesce(f.names, '') AS notices
FROM texts d LEFT JOIN whole w USING (id) LEFT JOIN known k ON k.digest = sha256(w.c) LEFT JOIN entire e USING (id) LEFT JOIN known ke ON ke.digest = sha256(e.c) LEFT JOIN found f ON f.doc_id IS NOT DISTINCT FROM d.doc_id WHERE d.id > 0
""",
    "op4_line_templates": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(doc_id, -9223372036854775808) AS key, doc_id, text FROM documents),
l AS (SELECT id, key, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM d),
m AS (SELECT *, string_split(t, ' ') AS ts FROM (SELECT *, trim(regexp_replace(regexp_replace(line, '[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*', '<*>', 'g'), '[ \t\x0B\f\r]+', ' ', 'g')) AS t FROM l)),
c AS (SELECT id, key, pos, t, ts, len(ts) AS n, array_to_string(ts[1:3], ' ') AS lead FROM m WHERE t <> ''),
pairs AS (SELECT DISTINCT n, lead, t, key FROM c),
leaves AS (SELECT n, lead, count(*) AS lines FROM pairs GROUP BY 1, 2 HAVING count(*) >= 10),
body AS (SELECT n, lead, t, lines, count(*) AS k, min(key) AS first FROM pairs JOIN leaves USING (n, lead) GROUP BY 1, 2, 3, 4),
token AS (SELECT n, lead, t, lines, k, unnest(string_split(t, ' ')[4:]) AS w, unnest(range(3, n)) AS i FROM body WHERE n > 3),
constant AS (SELECT n, lead, i, w FROM token WHERE w <> '<*>' GROUP BY 1, 2, 3, 4, lines HAVING sum(k) >= 10 AND 10 * sum(k) >= lines),
template AS (SELECT n, lead, t, array_to_string(list(CASE WHEN constant.i IS NULL THEN '<*>' ELSE token.w END ORDER BY token.i), ' ') AS tpl, count(constant.i) AS good
  FROM token LEFT JOIN constant USING (n, lead, i, w) GROUP BY 1, 2, 3),
often AS (SELECT n, lead, tpl, min(key) AS first FROM pairs JOIN (SELECT * FROM template WHERE 10 * good >= 5 * (n - 3)) USING (n, lead, t) GROUP BY 1, 2, 3 HAVING count(DISTINCT key) >= 10),
bad AS (SELECT n, lead, t, arg_min(first, own) AS first FROM (
  SELECT n, lead, t, first, 0 AS own FROM template JOIN often USING (n, lead, tpl) WHERE 10 * good >= 5 * (n - 3)
  UNION ALL SELECT n, lead, t, first, 1 FROM body WHERE k >= 10 AND 10 * len([w FOR w IN string_split(t, ' ') IF w <> '<*>']) >= 5 * n) GROUP BY 1, 2, 3),
hit AS (SELECT id, pos FROM c JOIN bad USING (n, lead, t) WHERE key > first),
kept AS (SELECT id, count(*) AS n_lines, count(hit.pos) AS n_dropped, list(line ORDER BY pos) FILTER (WHERE hit.pos IS NULL) AS ls FROM l LEFT JOIN hit USING (id, pos) GROUP BY id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_dropped, CASE WHEN text IS NOT NULL THEN sha256(array_to_string(coalesce(ls, []), chr(10))) END AS kept_sha256
FROM d JOIN kept USING (id)
""",
    "op5_quality_cascade": r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
grams AS (SELECT id, i, lead(i, 7) OVER o AS stop, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o,
  lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) AS gram FROM x WINDOW o AS (PARTITION BY id ORDER BY i)),
often AS (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS n FROM grams WHERE stop IS NOT NULL),
hit AS (SELECT DISTINCT id, i + unnest(range(8)) AS i FROM often WHERE n > 1),
rep AS (SELECT id, count(*) AS n FROM hit GROUP BY id),
lines AS (SELECT id, count(*) - count(DISTINCT l) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY id),
per AS (SELECT id, max(n) AS top FROM (SELECT id, word, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY id),
stut AS (SELECT id, count(*) AS n FROM (SELECT id, word = lag(word) OVER (PARTITION BY id ORDER BY i) AS same FROM x) WHERE same GROUP BY id),
f AS (SELECT w.id, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS up, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS low,
  length(text) - length(replace(text, '!', '')) AS bang, coalesce(per.top, 0) AS top, coalesce(stut.n, 0) AS stutters
  FROM w LEFT JOIN rep USING (id) LEFT JOIN lines USING (id) LEFT JOIN per USING (id) LEFT JOIN stut USING (id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 5 * n_symbols > n_words OR 2 * up > low OR 5 * bang > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 5 * top > 2 * n_words OR 10 * stutters > 3 * n_words OR 20 * n_dup_lines > n_words) AS kept
FROM g
""",
}
