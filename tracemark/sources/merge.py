"""A keyed table that grows by batches: key-hash buckets, runs that merge geometrically, a commit file a batch.

A batch adds a run of level 0 to the buckets that its keys fall in.  Two runs of a level merge into one of
the next, as digits carry, so after n batches a bucket has about log2(n) runs and each row has been rewritten
as often; a bucket that a batch doesn't touch isn't either.  Which runs are alive is said by the last commit
file, written under another name and renamed.  A batch that fails before leaves the table as it was, and one
that is run again after its commit changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemark.plans.storage import drop_path

BUCKETS = 64
_META = ("_batch", "_bucket")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _commits(spark: SparkSession, path: str) -> list[int]:
    fs, where = _files(spark, f"{path}/commits")
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def live_runs(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """{"schema": ..., "runs": {bucket: [[level, folder], ...]}} of the last commit (or of ``version``)."""
    known = _commits(spark, path)
    if version is None and not known:
        return {"schema": None, "runs": {}}
    fs, where = _files(spark, f"{path}/commits/{known[-1] if version is None else version}.json")
    stream = fs.open(where)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, number: int, state: dict) -> None:
    fs, final = _files(spark, f"{path}/commits/{number}.json")
    _, draft = _files(spark, f"{path}/commits/{number}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()
    if not fs.rename(draft, final):
        raise OSError(f"can't commit {final}")


def latest(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """The last row of each key: of the last batch that has it, there the last by ``order`` (else by its JSON)."""
    own = [c for c in rows.columns if c not in _META]
    last = F.struct("_batch", F.col(order) if order else F.to_json(F.struct(*own)))
    return rows.groupBy(key, "_bucket").agg(F.max_by(F.struct(*own, "_batch"), last).alias("r")).select("r.*", "_bucket")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, schema: StructType, folders: list[tuple[int, str]]) -> DataFrame:
    """The runs (bucket, folder)."""
    return spark.read.schema(schema).parquet(*[f for _, f in folders])


def put(batch: DataFrame, number: int, path: str, key: str = "event_id", order: str | None = None, buckets: int = BUCKETS) -> None:
    """Add the rows of batch ``number`` (rising) to the table; a key's row replaces the one before.

    Rows without a key are a key of their own.
    """
    spark = batch.sparkSession
    if number in _commits(spark, path):
        return
    state = live_runs(spark, path)
    if state["schema"] and state["buckets"] != buckets:
        raise ValueError(f"the table has {state['buckets']} buckets")
    rows = latest(batch.withColumn("_batch", F.lit(number).cast("long")).withColumn("_bucket", _bucket(key, buckets)), key, order)
    fresh = f"{path}/runs/{number}-0"
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(fresh)
    schema = rows.drop("_bucket").schema
    written = spark.read.schema(rows.schema).parquet(fresh)
    touched = [r["_bucket"] for r in written.select("_bucket").distinct().collect()]  # as many as there are buckets
    runs, merging = dict(state["runs"]), []
    for b in touched:
        carry, level, held = [f"{fresh}/_bucket={b}"], 0, {lv: f for lv, f in runs.get(str(b), [])}
        while level in held:
            carry.append(held.pop(level))
            level += 1
        where = f"{path}/runs/{number}-merged/_bucket={b}" if len(carry) > 1 else carry[0]
        merging += [(b, f) for f in carry] if len(carry) > 1 else []
        runs[str(b)] = sorted([[level, where], *([lv, f] for lv, f in held.items())])
    if merging:
        parts = _read(spark, schema, merging).withColumn("_bucket", _bucket(key, buckets))
        latest(parts, key, order).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/runs/{number}-merged")
    _commit(spark, path, number, {"schema": schema.jsonValue(), "buckets": buckets, "runs": runs})


def current(spark: SparkSession, path: str, key: str = "event_id", order: str | None = None, version: int | None = None) -> DataFrame:
    """The table: the last row of each key (as of commit ``version``)."""
    state = live_runs(spark, path, version)
    if not state["schema"]:
        raise FileNotFoundError(f"{path} has no commit")
    rows = _read(spark, StructType.fromJson(state["schema"]), [(int(b), f) for b, runs in state["runs"].items() for _, f in runs])
    return latest(rows.withColumn("_bucket", _bucket(key, state["buckets"])), key, order).drop(*_META)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the runs that the last commit doesn't name, and the commits before it; the number of runs deleted.  Not while others read the table."""
    state = live_runs(spark, path)
    alive = {f for runs in state["runs"].values() for _, f in runs}
    fs, where = _files(spark, f"{path}/runs")
    gone = 0
    for run in fs.listStatus(where):
        for part in fs.listStatus(run.getPath()):
            name = part.getPath().getName()
            if name.startswith("_bucket=") and f"{path}/runs/{run.getPath().getName()}/{name}" not in alive:
                fs.delete(part.getPath(), True)
                gone += 1
    for old in _commits(spark, path)[:-1]:
        drop_path(spark, f"{path}/commits/{old}.json")
    return gone
