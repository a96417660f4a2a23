"""MinHash near-dedup with ProbMinHash signatures.

Each shingle of five words, weighted by how often it occurs, is a Poisson
process: it sends arrivals, at a rate of its weight, to random registers, and a
register keeps the first shingle to arrive.  A text's processes stop as soon as
all registers have been reached before their next arrival.  Two texts agree in a
register with their probability-Jaccard similarity.  Bands of registers bring
texts together, and the weighted similarity of the shingles themselves, 0.8 or
more, decides.

Equal texts are one before anything else, and from there on a text is known by
its content, not by an id.  Verification takes two steps, and only verified
links are ever closed over.  First each text is compared with the least text that
shares a band with it, which settles groups of copies with one comparison a
text.  Then the buckets whose texts are not all of one class yet are verified
across their classes, a bucket beyond a size in pairs of blocks.  In a task a text
is compared with the texts of a class only until one of them is similar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import IS_MARK, LOWER, Words, bytes_of, documents, mix, pieces, starts_within, windows, written
from folio.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 one band in 25 agrees with probability 0.99995, at 0.3 with 0.06.
BANDS, ROWS = 25, 5
#: Words of the texts that one task verifies together, about 16 bytes each; one longer text is a task of its own.
BLOCK = 250_000
#: Rows of a few whole numbers, at most 64 bytes each in memory, that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000

#: What a null id counts as.
NO_ID = -(1 << 63)
_STEP, _TIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def bags(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text of a batch: text, shingle, count, by text and shingle.

    A text of one to four words is one shingle.
    """
    n_words = words.counts()
    good = starts_within(words.first, SHINGLE, len(words.hash))
    at = np.flatnonzero(good)
    text = np.repeat(np.arange(len(n_words)), n_words)[at]
    shingle = windows(words.hash, SHINGLE)[at]
    few = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(few):
        text = np.concatenate([text, few])
        shingle = np.concatenate([shingle, np.array([windows(words.hash[words.first[i] : words.first[i + 1]], int(n_words[i]))[0] for i in few], np.uint64)])
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    return text[first], shingle[first], np.diff(np.append(first, len(text)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash of weighted sets: one row of ``registers`` shingles per text.

    All processes of a batch advance together, one arrival a round; one whose
    next arrival is later than its text's slowest register has ended.
    """
    first = np.full(texts * registers, np.inf)
    slowest = np.full(texts, np.inf)
    active = np.arange(len(text))
    clock = np.zeros(len(text))
    rate = weight.astype(float)
    arrivals: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = 0
    while len(active):
        step += 1
        seed = mix(shingle[active] + np.uint64(step * int(_STEP) % 2**64))
        uniform = (mix(seed ^ _TIME) >> np.uint64(11)).astype(float) * 2.0**-53
        clock = clock - np.log1p(-uniform) / rate[active]
        in_time = clock < slowest[text[active]]
        active, clock, seed = active[in_time], clock[in_time], seed[in_time]
        place = text[active] * registers + (seed % np.uint64(registers)).astype(np.int64)
        arrivals.append((place, clock, shingle[active]))
        np.minimum.at(first, place, clock)
        touched = np.unique(text[active])
        slowest[touched] = first.reshape(texts, registers)[touched].max(1)
    out = np.zeros(texts * registers, np.uint64)
    if arrivals:
        place, when, what = (np.concatenate(x) for x in zip(*arrivals, strict=True))
        order = np.argsort(-when, kind="stable")
        out[place[order]] = what[order]
    return out.reshape(texts, registers)


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    for i in range(rows):
        out = out * _STEP + mix(signature[:, i::rows][:, :bands])
    return mix(out + np.arange(bands, dtype=np.uint64))


def _sign(batches):
    for batch in pieces(batches, 512, 1 << 20):
        data, offsets = bytes_of(batch.column(1))
        words = Words(data, offsets, IS_MARK, LOWER)
        text, shingle, weight = bags(words)
        hashes = band_hashes(signatures(text, shingle, weight, batch.num_rows)).astype(np.int64)
        keys, nodes = _names(words)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, BANDS, dtype=np.int32)), pa.array(hashes.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(nodes), pa.array(words.counts(), pa.int64()), lists], ["doc_id", "key", "node", "n_words", "bands"])


def _names(words: Words) -> tuple[list[str | None], np.ndarray]:
    """What a text is known by: the digest of its words, and half of it as a number; none for texts without words."""
    raw = [xxhash.xxh3_128_digest(words.hash[a:b].tobytes()) if b > a else None for a, b in zip(words.first, words.first[1:], strict=False)]
    return [x and x.hex() for x in raw], np.array([int.from_bytes(x[:8], "little", signed=True) if x else 0 for x in raw], np.int64)


def _bags(batches):
    for batch in pieces(batches, 512, 1 << 20):
        data, offsets = bytes_of(batch.column(batch.schema.get_field_index("text")))
        words = Words(data, offsets, IS_MARK, LOWER)
        text, shingle, weight = bags(words)
        cuts = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
        # Shingles ascend as unsigned numbers; they travel as signed ones.
        bag = [pa.ListArray.from_arrays(cuts, pa.array(shingle.view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(weight.astype(np.int32)))]
        names = [x for x in batch.schema.names if x != "text"]
        out = pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *bag], [*names, "shingles", "weights"])
        # Another text of the same id isn't the one that was asked for.
        yield out.filter(pa.array(_names(words)[1] == batch.column(batch.schema.get_field_index("node")).to_numpy()))


Bag = tuple[np.ndarray, np.ndarray, int]


def similar(a: Bag, b: Bag, least: float = SIMILARITY) -> bool:
    """Whether two weighted sets (ascending members, weights, their sum) are similar: sum of minima over sum of maxima."""
    if min(a[2], b[2]) < least * max(a[2], b[2]):
        return False
    place = np.searchsorted(b[0], a[0])
    place[place == len(b[0])] = 0
    same = b[0][place] == a[0]
    common = int(np.minimum(a[1][same], b[1][place[same]]).sum())
    return common >= least * (a[2] + b[2] - common)


def links(nodes: list[int], sets: list[Bag], labels: list[int], sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of similar texts that join all classes which any such pair joins.

    Texts of one label are of one class from the start.  With ``sides`` (0 or 1)
    only texts of different sides are compared.
    """
    groups: list[dict] = []
    found = []
    for i in range(len(nodes)):
        hits, label = [], labels[i]
        for g in groups:
            if label in g["labels"]:
                hits.append(g)
                continue
            # The latest members first: copies of one text come in runs.
            j = next((j for j in reversed(g["members"]) if (sides is None or sides[i] != sides[j]) and similar(sets[i], sets[j])), None)
            if j is not None:
                hits.append(g)
                found.append((nodes[i], nodes[j]))
        own = {"labels": {label}, "members": [i]}
        if hits:
            own["labels"] |= set().union(*(g["labels"] for g in hits))
            own["members"] = [j for g in hits for j in g["members"]] + [i]
            groups = [g for g in groups if not any(g is h for h in hits)]
        groups.append(own)
    return found


def _sets(frame: pd.DataFrame) -> list[Bag]:
    return [(np.asarray(s).view(np.uint64), np.asarray(w).astype(np.int64), int(np.sum(w))) for s, w in zip(frame["shingles"], frame["weights"], strict=True)]


def _pairs(found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _verify_centre(frame: pd.DataFrame) -> pd.DataFrame:
    """Which texts of a group are similar to its centre."""
    frame = frame.drop_duplicates("node")
    centre = frame.index[frame["node"] == frame["centre"]]
    if not len(centre):
        return _pairs([])
    sets = dict(zip(frame.index, _sets(frame), strict=True))
    return _pairs([(n, c) for i, n, c in zip(frame.index, frame["node"], frame["centre"], strict=True) if n != c and similar(sets[i], sets[centre[0]])])


def _verify_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.drop_duplicates("node").sort_values(["label", "node"])
    x, y = frame["x"].iloc[0], frame["y"].iloc[0]
    sides = None if x == y else (frame["own"] == y).astype(int).tolist()
    return _pairs(links(frame["node"].tolist(), _sets(frame), frame["label"].tolist(), sides))


def _small(df: DataFrame) -> DataFrame:
    """With a broadcast hint where the table, which is written, has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _with_bags(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """The bags of the texts that ``tasks`` (``rep``, ``node`` and more) name."""
    rows = docs.join(_small(tasks), docs["doc_id"] == tasks["rep"]).select(*tasks.columns, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tasks.schema) + ", shingles array<long>, weights array<int>"
    return rows.mapInArrow(_bags, schema)


def _buckets(texts: DataFrame) -> DataFrame:
    """``band``, ``hash``, ``node``, ``least`` and what else a text has, for the texts of buckets of two or more."""
    entry = texts.select("node", "rep", "n_words", F.posexplode("bands").alias("band", "hash"))
    bucket = entry.groupBy("band", "hash").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("band", "hash", "least")
    return entry.join(bucket, ["band", "hash"])


def _centre_links(docs: DataFrame, entry: DataFrame, block: int) -> DataFrame:
    """Links (``a``, ``b``) of texts to the least text that shares a band with them, where the two are similar."""
    near = entry.groupBy("node").agg(F.min("least").alias("centre"), F.first("rep").alias("rep"), F.first("n_words").alias("n_words"))
    size = near.groupBy("centre").agg(F.ceil(F.sum("n_words") / block).cast("int").alias("blocks"))
    own = near.where("node <> centre").join(size, "centre").select("node", "rep", "centre", F.expr("int(pmod(xxhash64(node), blocks))").alias("part"))
    # A centre stands once in each part of its group.
    middle = own.select("centre", "part").distinct().join(near.select(F.col("node").alias("centre"), "rep"), "centre").select(F.col("centre").alias("node"), "rep", "centre", "part")
    tasks = written(own.unionByName(middle), "centres")
    return _with_bags(docs, tasks).groupBy("centre", "part").applyInPandas(_verify_centre, "a long, b long")


def _class_links(docs: DataFrame, entry: DataFrame, label: DataFrame, block: int) -> DataFrame:
    """Links between texts of one bucket that ``label`` doesn't have in one class."""
    entry = entry.join(label.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").withColumn("label", F.coalesce("label", "node"))
    bucket = (
        entry.groupBy("band", "hash")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"), F.ceil(F.sum("n_words") / block).cast("int").alias("blocks"))
        .where("low < high")
    )
    # Of buckets with the same texts one is enough.
    bucket = bucket.groupBy("n", "sum", "xor").agg(F.min(F.struct("band", "hash", "blocks")).alias("b")).select("b.*")
    member = entry.join(bucket, ["band", "hash"]).withColumn("own", F.expr("int(pmod(xxhash64(node), blocks))"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    task = member.select("node", "rep", "label", "band", "hash", "own", other.alias("other"))
    task = task.select("node", "rep", "label", "band", "hash", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    return _with_bags(docs, written(task, "tasks")).groupBy("band", "hash", "x", "y").applyInPandas(_verify_bucket, "a long, b long")


def _classified(docs: DataFrame, block: int) -> DataFrame:
    """Per row ``doc_id``, ``key``, ``class_id`` and ``chosen``, whether it is of the document that stands for its class."""
    signed = written(docs.mapInArrow(_sign, "doc_id long, key string, node long, n_words long, bands array<long>"), "signatures")
    texts = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("node").alias("node"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"))
    texts = written(texts, "texts")
    entry = written(_buckets(texts), "buckets")
    first = written(_centre_links(docs, entry, block), "centre-links")
    rest = written(_class_links(docs, entry, components(first), block), "class-links")
    label = written(components(first.unionByName(rest)), "classes")
    label = texts.select("key", "rep", "node").join(label.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("key", "rep", F.coalesce("label", "node").alias("label"))
    least = label.groupBy("label").agg(F.min(F.struct("rep", "key")).alias("least"))
    named = label.join(least, "label").select(F.col("key").alias("k"), F.col("least.rep").alias("c"), (F.col("key") == F.col("least.key")).alias("own"))
    # Texts without words have no key, and no class but their own.
    found = signed.select("doc_id", "key").join(named, F.col("key") == F.col("k"), "left")
    return found.select("doc_id", "key", F.coalesce("c", "doc_id").alias("class_id"), F.coalesce(F.col("own") & (F.col("doc_id") == F.col("c")), F.lit(True)).alias("chosen"))


def _rows(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id`` and ``class_id``, the smallest id of its class.

    A class is a connected component of equal texts and of texts similar by 0.8
    or more that share a band.  Words are lower-cased and stripped of ASCII
    punctuation.  Null, empty and wordless texts are each a class of their own;
    rows of one ``doc_id`` get a row each, by their own texts; a null ``doc_id``
    counts as the smallest long; an empty table gives an empty result.  Other
    columns are dropped, whatever their names.  Texts of any length are taken
    whole; ``block`` words of texts are verified together, and a longer text alone.
    """
    return _classified(_rows(docs), block).select("doc_id", "class_id")


def _keyed(place: int):
    def run(batches):
        for batch in pieces(batches, 512, 1 << 20):
            words = Words(*bytes_of(batch.column(batch.schema.get_field_index("text"))), IS_MARK, LOWER)
            yield batch.set_column(place, batch.schema.names[place], pa.array(_names(words)[0], pa.string()))

    return run


def without_near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, of one document (the smallest id) of each class.

    Where one id has different texts, only the rows of the text that stands for
    the class stay (the least by digest, if several do); equal rows of it all stay.
    """
    verdict = written(_classified(_rows(docs), block), "verdicts")
    per_id = verdict.groupBy("doc_id").agg(F.bool_or("chosen").alias("some"), F.bool_and("chosen").alias("all"))
    gone = _small(written(per_id.where("not all").select(F.col("doc_id").alias("gone_id"), "some"), "gone"))
    own = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
    out = docs.join(gone, own == gone["gone_id"], "left_anti")
    # Ids of which some texts stay and others go; no id of a table with unique ids is.
    torn = docs.join(gone.where("some"), own == gone["gone_id"], "left_semi")
    if torn.isEmpty():
        return out
    name = "_".join(["key", *docs.columns])
    keyed = torn.withColumn(name, F.lit(None).cast("string"))
    keyed = keyed.mapInArrow(_keyed(len(docs.columns)), keyed.schema)
    stay = verdict.where("chosen").select(F.col("doc_id").alias("stay_id"), F.col("key").alias("stay_key")).distinct()
    same = (F.coalesce(keyed["doc_id"].cast("long"), F.lit(NO_ID)) == stay["stay_id"]) & F.equal_null(keyed[name], stay["stay_key"])
    return out.unionByName(keyed.join(stay, same, "left_semi").select(*docs.columns))
