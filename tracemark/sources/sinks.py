"""Writers: JSON lines, transcripts, documents, HTML and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.functions.text import script_safe


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_transcript(lines: DataFrame, path: str) -> None:
    """One event a line in order of time; part files follow each other by range."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(n, "ts", "event_id").sortWithinPartitions("ts", "event_id")
    ordered.select("line").write.mode("overwrite").text(path)


def _whole(rows: list, limit: int) -> list:
    if len(rows) > limit:
        raise ValueError(f"the result has more than {limit} rows")
    return rows


def document(df: DataFrame, limit: int = 10_000) -> str:
    """A small result as one JSON document with sorted keys (for headline tables only); a larger one is an error."""
    rows = [json.loads(x) for x in _whole(df.toJSON().take(limit + 1), limit)]
    return json.dumps(rows, indent=2, ensure_ascii=False, sort_keys=True)


def html(df: DataFrame, column: str, title: str) -> DataFrame:
    """Rows with their JSON embedded in a page, escaped so that no text can close the script."""
    page = F.concat(F.lit(f"<!doctype html><title>{title}</title><script id=data type=application/json>"), script_safe(F.col(column)), F.lit("</script>"))
    return df.withColumn("html", page)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small table as Markdown; a larger one is an error."""
    rows = _whole(df.take(limit + 1), limit)
    bar = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([bar(df.columns), bar(["-"] * len(df.columns)), *map(bar, rows)])
