"""JSON-lines folders as a data source that Spark reads and streams, lines numbered by file.

``spark.read.format("tracemark_lines")`` and ``readStream`` give path, file, line_no and value of the files of a
folder (option ``stem``: only <stem>.jsonl and <stem>.jsonl.gz; blank lines count but don't come).  A file is one
partition, read as Arrow batches; for files of many blocks ``jsonl.read_lines`` divides the work further.  A stream's
offset is the last file that it has taken, by time of change and path: files must be moved in whole.
Folders are reached through Arrow's file systems, so by path or by a URI that these know.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tracemark.sources.adapters import Transcript

NAME = "tracemark_lines"
ROWS = 8192
_SCHEMA = pa.schema([("path", pa.string()), ("file", pa.string()), ("line_no", pa.int64()), ("value", pa.string())])


@dataclass
class OneFile(InputPartition):
    folder: str
    path: str


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _listing(folder: str, stem: str | None) -> list[tuple[int, str]]:
    """(time of change in ns, path) of the folder's files, in order."""
    fs, where = _open(folder)
    names = tuple(f"{stem}.jsonl{z}" for z in ("", ".gz")) if stem else None
    wanted = lambda f: f.is_file and (f.base_name in names if names else f.base_name.endswith((".jsonl", ".jsonl.gz")))
    return sorted((f.mtime_ns, f.path) for f in fs.get_file_info(pafs.FileSelector(where, recursive=True)) if wanted(f))


def _read(part: OneFile) -> Iterator[pa.RecordBatch]:
    fs, _ = _open(part.folder)
    name, rows, rest, number = part.path.rsplit("/", 1)[-1], [], b"", 0

    def batch() -> pa.RecordBatch:
        columns = [[part.path] * len(rows), [name] * len(rows), [n for n, _ in rows], [v for _, v in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    with fs.open_input_stream(part.path, compression="gzip" if name.endswith(".gz") else None) as stream:
        while True:
            block = stream.read(1 << 20)
            lines = (rest + block).split(b"\n")
            rest = lines.pop() if block else b""
            for line in lines:
                number += 1
                if line.strip():
                    rows.append((number, line.removesuffix(b"\r").decode("utf-8", "replace")))
                if len(rows) >= ROWS:
                    yield batch()
                    rows.clear()
            if not block:
                break
    if rows:
        yield batch()


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.stem = options["path"], options.get("stem")

    def partitions(self) -> list[OneFile]:
        return [OneFile(self.folder, path) for _, path in _listing(self.folder, self.stem)]

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        return _read(partition) if partition is not None and partition.path else iter(())


class LinesStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.stem = options["path"], options.get("stem")

    def initialOffset(self) -> dict:
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:
        known = _listing(self.folder, self.stem)
        return {"changed": known[-1][0], "path": known[-1][1]} if known else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[OneFile]:
        after, upto = (start["changed"], start["path"]), (end["changed"], end["path"])
        return [OneFile(self.folder, f[1]) for f in _listing(self.folder, self.stem) if after < f <= upto]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        pass


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, file string, line_no long, value string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(dict(self.options))

    def streamReader(self, schema) -> LinesStream:
        return LinesStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LinesSource)


class TranscriptStream(Transcript):
    """The transcript adapter over files as they come in: its events (but for turns, which need their session), by ``events()``."""

    def __init__(self, spark: SparkSession, folder: str, source: str = "transcript"):
        super().__init__(spark, folder, source)
        register(spark)

    def raw(self, stem: str, contains: str | None = None, whole_line: bool = False) -> DataFrame:
        rows = self.spark.readStream.format(NAME).option("stem", stem).load(self.folder)
        rows = rows.filter(F.col("value").contains(contains)) if contains else rows
        more = ["line_text"] if whole_line else []
        rows = rows.select(F.concat_ws(":", "file", "line_no").alias("raw_ref"), F.col("value").alias("line_text"), F.from_json("value", self.RAW[stem]).alias("r"))
        return rows.select("raw_ref", *more, "r.*")
