"""Rows in order without a window over a whole group: one sort by range, small figures per part, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemark.plans.storage import stored

_IN_PART = (1 << 33) - 1


def sorted_parts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` sorted by range, with ``_part`` and ``_at`` (the place there); nulls last, null is a group.

    A large group lies in many parts.  The sorted rows are written once: ids must not change between readings.
    """
    by = [F.col(c).asc_nulls_last() for c in (*keys, *order)]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    table = stored(rows.sparkSession, sorted_, "sorted")
    return table.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(_IN_PART)).drop("_id")


def with_part_figures(table: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` joined with the row of ``parts`` (_part, keys, figures) of its part and group."""
    same = ["_part", *keys]
    p = parts.select(*[F.col(c).alias(f"_p{c}") for c in same], *[c for c in parts.columns if c not in same])
    on = F.col("_part") == F.col("_p_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_p{k}"))
    return table.join(p, on).drop(*[f"_p{c}" for c in same])


def earlier(keys: list[str], *order: Column | str):
    """The window of the rows before this one in the order of ``order`` within ``keys``."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def ranked(rows: DataFrame, keys: list[str], order: list[str], place: str, total: str) -> DataFrame:
    """``rows`` with ``place``, from 1 in the order of ``order`` (nulls last) within each group of ``keys`` (null is a group), and ``total``, the group's rows.

    How many rows of a group each part holds is a small table.
    """
    table = sorted_parts(rows, keys, order)
    parts = table.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier(keys, "_part")), F.lit(0))).withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    return with_part_figures(table, parts, keys).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_low") + 1).alias(place), total)


def numbered(rows: DataFrame, keys: list[str], order: list[str], place: str) -> DataFrame:
    """``rows`` with ``place`` alone."""
    return ranked(rows, keys, order, place, "_total").drop("_total")
