"""Fetching as a data source: tasks by host, paced, retried, each answer kept as it comes.

``fetch_all`` deals the URLs into files, one a task: small hosts share a task,
a host of many URLs is split over several, which share its pace.  The reader
behind :func:`fetch_source` has a partition a file.  A task writes each answer
down before it goes on, so that a task that is run again, on whatever machine,
reads what its forerunner got and asks only for the rest.
"""

from __future__ import annotations

import hashlib
import time
import urllib.error
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folio.functions.text import host_of
from folio.sources.snapshots import http_get

NAME = "folio_fetch"
ANSWER = "url string, final_url string, content_type string, content binary, error string"
_ARROW = pa.schema([("url", pa.string()), ("final_url", pa.string()), ("content_type", pa.string()), ("content", pa.binary()), ("error", pa.string())])
Get = Callable[[str, float], tuple[str, str, bytes]]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path as Arrow sees it: a URI, or a folder that all machines share."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Job(InputPartition):
    path: str


class Spool:
    """Answers that were kept, one file each, named by the URL; a file appears when it is whole."""

    def __init__(self, folder: str):
        self.store, self.folder = opened(folder)

    def _path(self, url: str) -> str:
        name = hashlib.sha256(url.encode()).hexdigest()
        return f"{self.folder}/{name[:2]}/{name}.arrow"

    def get(self, url: str) -> pa.RecordBatch | None:
        path = self._path(url)
        if self.store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.store.open_input_file(path) as file:
            return pa.ipc.open_file(file).get_batch(0)

    def put(self, url: str, answer: tuple) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, (url, *answer), strict=True))], _ARROW)
        path = self._path(url)
        self.store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with self.store.open_output_stream(part) as file, pa.ipc.new_file(file, _ARROW) as out:
            out.write_batch(batch)
        self.store.move(part, path)
        return batch


def passes(error: Exception) -> bool:
    """Whether asking again may help: the server is busy or failed, or couldn't be reached."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code == 429 or error.code >= 500
    return isinstance(error, OSError)


class Reader(DataSourceReader):
    def __init__(self, options: dict, get: Get):
        self.folder, self.get = options["folder"], get
        self.timeout, self.retries, self.pause = float(options["timeout"]), int(options["retries"]), float(options["pause"])
        self.quarantine, self.per_second = options["quarantine"] == "true", float(options["per_second"])

    def partitions(self) -> list[Job]:
        store, path = opened(f"{self.folder}/jobs")
        files = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [Job(f.path) for f in sorted(files, key=lambda f: f.path) if f.path.endswith(".parquet")] or [Job("")]

    def ask(self, url: str) -> tuple:
        for turn in range(self.retries + 1):
            try:
                return (*self.get(url, self.timeout), None)
            except Exception as error:
                if turn < self.retries and passes(error):
                    time.sleep(self.pause * 2**turn)
                elif self.quarantine:
                    return None, None, None, str(error)
                else:
                    raise
        raise AssertionError("unreachable")

    def read(self, partition: Job) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if not partition.path:
            return
        spool, store = Spool(f"{self.folder}/answers"), opened(self.folder)[0]
        due: dict[str, float] = {}
        with store.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(1024, columns=["url", "host", "parts"]):
                for url, host, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    kept = spool.get(url)
                    if kept is None:
                        if self.per_second:
                            # A host's pace is shared by the tasks that it is split over.
                            time.sleep(max(0.0, due.get(host, 0) - time.monotonic()))
                            due[host] = time.monotonic() + parts / self.per_second
                        kept = spool.put(url, self.ask(url))
                    yield kept


def fetch_source(get: Get = http_get) -> type[DataSource]:
    """The data source over ``get``, to be registered with a session."""

    class FetchSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def schema(self) -> str:
            return ANSWER

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options, get)

    return FetchSource


def write_jobs(urls: DataFrame, folder: str, urls_a_task: int = 1000) -> None:
    """Deals each URL, once, into one of the files below ``folder``: by host, hosts beyond ``urls_a_task`` in parts by the URL's hash."""
    wanted = urls.select("url").distinct().withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    wanted.write.mode("overwrite").parquet(f"{folder}/wanted")
    wanted = urls.sparkSession.read.schema("url string, host string").parquet(f"{folder}/wanted")
    sizes = wanted.groupBy("host").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / urls_a_task).cast("int")
    dealt = wanted.join(sizes, "host").select("url", "host", parts.alias("parts"), F.pmod(F.xxhash64("url"), parts).alias("part"))
    tasks = max(1, -(-wanted.count() // urls_a_task))
    # Within a task hosts take turns, so that their pauses overlap.
    dealt.repartition(tasks, "host", "part").sortWithinPartitions(F.xxhash64("url")).select("url", "host", "parts").write.mode("overwrite").parquet(f"{folder}/jobs")


def fetch_all(
    urls: DataFrame, folder: str, get: Get = http_get, timeout_ms: int = 60_000, quarantine: bool = False, retries: int = 2, pause: float = 0.5, per_second: float = 0, urls_a_task: int = 1000
) -> DataFrame:
    """``url``, ``final_url``, ``content_type``, ``content`` and ``error`` of each URL, asked for once.

    ``folder``, which all machines share, holds the jobs and the answers: reading
    the result again, or failing on the way, asks for nothing twice.  ``per_second``
    bounds how often a host is asked (0: as fast as it answers).  Busy and failing
    servers are asked ``retries`` times more.  A failure ends the run or, with
    ``quarantine``, becomes a row with ``error``.
    """
    spark = urls.sparkSession
    write_jobs(urls, folder, urls_a_task)
    spark.dataSource.register(fetch_source(get))
    options = {"folder": folder, "timeout": timeout_ms / 1000, "retries": retries, "pause": pause, "per_second": per_second, "quarantine": str(quarantine).lower()}
    return spark.read.format(NAME).options(**{k: str(v) for k, v in options.items()}).load()
