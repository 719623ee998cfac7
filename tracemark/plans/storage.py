"""Intermediate tables in the folder that the driver and all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where that setting is
absent and everything runs in one process (unit tests, a laptop) a private temporary folder takes its place; with
executors elsewhere that is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The URI of the shared folder, without a trailing slash."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tracemark-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it.

    The lineage ends here: a lost executor costs a re-read of this table, never the work before it.
    """
    path = path or fresh_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that is no longer needed (a missing path is no error)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
