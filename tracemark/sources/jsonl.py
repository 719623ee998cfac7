"""JSON lines, plain or compressed, with line provenance; whole JSON documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def find(spark: SparkSession, folder: str, stem: str) -> str:
    """The plain file if there is one, else the compressed one."""
    for name in (f"{folder}/{stem}.jsonl", f"{folder}/{stem}.jsonl.gz"):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return name
    raise FileNotFoundError(f"{folder}/{stem}.jsonl[.gz]")


_LINE = "path string, block long, at long, value string"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (path, block, value) with their place in their block of the file; a task reads blocks one after the other."""
    key, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(1).to_numpy(zero_copy_only=False)
        path = batch.column(0).dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (path[1:] != path[:-1])) + 1).tolist(), batch.num_rows]
        at = np.arange(batch.num_rows)
        for a, e in zip(cuts[:-1], cuts[1:]):
            now = (batch.column(0)[a].as_py(), int(block[a]))
            seen = seen if now == key else 0
            at[a:e] += seen - a
            key, seen = now, seen + e - a
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at), batch.column(2)], names=["path", "block", "at", "value"])


def read_lines(spark: SparkSession, path: str, contains: str | None = None) -> DataFrame:
    """(path, file, line_no, value): line numbers count blank lines, which are then left out; ``file`` is the last part of ``path``.

    A line's place in its block comes from the scan, without moving the lines; how many lines the blocks before
    hold is a small table, keyed by the whole path (two folders may hold files of one name).
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    lines = raw.mapInArrow(_placed, _LINE).filter(F.trim("value") != "")
    lines = lines.filter(F.col("value").contains(contains)) if contains else lines
    file = F.element_at(F.split("path", "/"), -1)
    return lines.join(sizes, ["path", "block"]).select("path", file.alias("file"), (F.col("before") + F.col("at") + 1).alias("line_no"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str, contains: str | None = None, whole_line: bool = False) -> DataFrame:
    """Parsed rows with raw_ref = file:line (and line_text if wanted); only the named fields are read."""
    rows = read_lines(spark, path, contains)
    more = [F.col("value").alias("line_text")] if whole_line else []
    return rows.select(F.concat_ws(":", "file", "line_no").alias("raw_ref"), *more, F.from_json("value", schema).alias("r")).select("raw_ref", *(["line_text"] if whole_line else []), "r.*")


def read_documents(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Whole JSON documents with the name of their file, to be ordered by it."""
    return spark.read.schema(schema).json(glob, multiLine=True).withColumn("file", F.col("_metadata.file_name"))


def read_day_map(spark: SparkSession, path: str) -> DataFrame:
    """(day, date) of every ``"day": n, "date": "..."`` of a text, without parsing it."""
    text = spark.read.text(path, wholetext=True)
    pair = F.explode(F.regexp_extract_all("value", F.lit(r'("day":\s*\d+,\s*"date":\s*"[0-9-]{10})'), 1)).alias("p")
    return text.select(pair).select(F.regexp_extract("p", r"(\d+),", 1).cast("int").alias("day"), F.to_date(F.right("p", F.lit(10))).alias("date")).distinct()


def key_frequency(rows: DataFrame, column: str, sample: int | None = None) -> DataFrame:
    """How often each top-level key occurs in JSON texts: in all of them, or in the first ``sample``."""
    rows = rows if sample is None else rows.limit(sample)
    return rows.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
