"""Commits of a Parquet log: what each finished write added, and a stream that follows them.

A write puts its files in a folder of its own, ``topic=<topic>/batch=<batch>``, and then one small file below
``_commits`` that says which offsets of each partition they hold.  That file appears in one piece, and only folders
named by one are read.  So a write that fails leaves nothing, and a write done twice counts once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from topicspark.model import LOG_COLUMNS, LOG_SCHEMA

COMMIT = "topic STRING, batch STRING, partition INT, first_offset BIGINT, next_offset BIGINT, records BIGINT"
_COMMITS = "_commits"
_NAME = re.compile(r"[A-Za-z0-9._-]+")
FORMAT = "committed_log"


def _folder(kind: str, topic: str, batch: str) -> str:
    for name in (topic, batch):
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a name of letters, digits, dots, dashes and underscores: {name!r}")
    return f"{kind}topic={topic}/batch={batch}"


def data_folder(path: str, topic: str, batch: str) -> str:
    return f"{path.rstrip('/')}/{_folder('', topic, batch)}"


def commit_folder(path: str, topic: str, batch: str) -> str:
    return f"{path.rstrip('/')}/{_folder(_COMMITS + '/', topic, batch)}"


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def commits(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame | None:
    """One row per commit and partition, or None for a log without commits."""
    try:
        return spark.read.schema(COMMIT).json(f"{path.rstrip('/')}/{_COMMITS}/topic={topic or '*'}/batch=*")
    except AnalysisException as error:
        if _missing(error):
            return None
        raise


def write_commit(counts: DataFrame, path: str, topic: str, batch: str) -> None:
    """Make a written batch part of the log; ``counts`` has partition, first_offset, next_offset and records."""
    row = counts.select(
        F.lit(topic).alias("topic"), F.lit(batch).alias("batch"), "partition", "first_offset", "next_offset", "records"
    )
    row.coalesce(1).write.mode("overwrite").json(commit_folder(path, topic, batch))


def read_committed(spark: SparkSession, path: str, options: dict[str, str], topics: Sequence[str] | None) -> DataFrame | None:
    """The log as its commits have it at this moment, with files that lie in the topics' folders themselves (put there
    by other writers); None for a log without commits."""
    known = commits(spark, path)
    if known is None:
        return None
    path = path.rstrip("/")
    done = known.select("topic", "batch").distinct()
    if topics:
        done = done.filter(F.col("topic").isin(list(topics)))
    schema = T.StructType([*LOG_SCHEMA.fields, T.StructField("batch", T.StringType())])
    parts = []
    for at, columns in ((f"{path}/topic=*/batch=*", schema), (f"{path}/topic=*/*.parquet", LOG_SCHEMA)):
        try:
            parts.append(spark.read.options(**options).option("basePath", path).schema(columns).parquet(at))
        except AnalysisException as error:
            if not _missing(error):
                raise
            parts.append(spark.createDataFrame([], columns))
    # One row per finished write; the folders of others are pruned by it.
    batches = parts[0].join(F.broadcast(done), ["topic", "batch"], "left_semi").select(*LOG_COLUMNS)
    return batches.unionByName(parts[1].select(*LOG_COLUMNS))


class _Files(InputPartition):
    def __init__(self, path: str, topic: str):
        self.path, self.topic = path, topic


class CommittedLog(DataSource):
    """Stream over the commits of a log: ``path``, ``topics`` (comma-separated, optional), ``start``: ``earliest`` or
    ``latest``.

    A position is the next offset of each partition of each topic.  A query without a checkpoint begins at the start,
    or behind the last commit; after that its checkpoint alone says where it goes on, so nothing that came while it was
    down is passed over.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return LOG_SCHEMA

    def streamReader(self, schema: T.StructType) -> CommitReader:
        return CommitReader(self.options)


class CommitReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        topics = options.get("topics")
        self.path = options["path"].rstrip("/")
        self.topics = set(topics.split(",")) if topics else None
        self.latest = options.get("start", "earliest") == "latest"

    def _opened(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def _commits(self) -> list[dict]:
        """All commits, each topic's in order of their offsets."""
        from pyarrow import fs

        files, root = self._opened()
        found = files.get_file_info(fs.FileSelector(f"{root}/{_COMMITS}", recursive=True, allow_not_found=True))
        out = []
        for info in found:
            if info.type != fs.FileType.File or not info.path.endswith(".json") or "/_" in info.path[len(root) + len(_COMMITS) + 1 :]:
                continue
            with files.open_input_stream(info.path) as stream:
                rows = [json.loads(line) for line in stream.read().splitlines() if line.strip()]
            out += [row for row in rows if self.topics is None or row["topic"] in self.topics]
        return sorted(out, key=lambda row: (row["topic"], row["partition"], row["first_offset"]))

    @staticmethod
    def _place(row: dict) -> str:
        return f"{row['topic']}/{row['partition']}"

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.latest else {}

    def latestOffset(self) -> dict:
        return {self._place(row): row["next_offset"] for row in self._commits()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        from pyarrow import fs

        added = {
            (row["topic"], row["batch"]) for row in self._commits()
            if start.get(self._place(row), 0) <= row["first_offset"] and row["next_offset"] <= end.get(self._place(row), 0)
        }
        files, root = self._opened()
        out = []
        for topic, batch in sorted(added):
            held = files.get_file_info(fs.FileSelector(f"{root}/{_folder('', topic, batch)}"))
            out += [_Files(info.path, topic) for info in held if info.path.endswith(".parquet")]
        return out

    def read(self, partition: _Files) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, _ = self._opened()
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string()]
        with files.open_input_file(partition.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=10_000, columns=LOG_COLUMNS[1:]):
                topic = pa.array([partition.topic] * batch.num_rows, pa.string())
                columns = [topic, *[batch.column(name).cast(kind, safe=False) for name, kind in zip(LOG_COLUMNS[1:], kinds[1:], strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, LOG_COLUMNS)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: a log keeps its records."""


def stream_committed(spark: SparkSession, path: str, topics: Sequence[str] | None, latest: bool) -> DataFrame:
    spark.dataSource.register(CommittedLog)
    reader = spark.readStream.format(FORMAT).option("path", path).option("start", "latest" if latest else "earliest")
    return (reader.option("topics", ",".join(topics)) if topics else reader).load()
