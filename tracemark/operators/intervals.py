"""Interval joins by dyadic cells.

Time is a binary tree of cells, the finest 2 ** ``finest`` microseconds long.  An interval is the union of a
few disjoint cells, at most two a level; a point lies in one cell of each level.  A point and an interval
that holds it so share exactly one cell: an equi-join, whatever the interval's length, and each pair once.
Two intervals overlap when one of them holds the other's beginning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of 18 minutes; events that lie closer together meet in one.
FINEST = 30
_FAR = "2100-01-01"


def interval_cells(low: Column, high: Column, levels: int) -> Column:
    """The disjoint cells (level, cell) of the whole cells low to high, both included."""
    start = lambda k: F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
    stop = lambda k: F.call_function("shiftright", high + 1, k)
    cell = lambda k, c, wanted: F.when((start(k) < stop(k)) & wanted, F.struct(k.alias("level"), c.alias("cell")))
    both = lambda k: F.array(cell(k, start(k), start(k) % 2 == 1), cell(k, stop(k) - 1, stop(k) % 2 == 1))
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), both)))


def point_cells(at: Column, levels: int) -> Column:
    """The cell of each level that holds the whole cell ``at``."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", at, k).alias("cell")))


def holding(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, finest: int = FINEST) -> DataFrame:
    """Points with the intervals in which they lie, both ends included, columns of both.  Rows without a time meet nothing."""
    first, last = points.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    if first is None:
        return points.join(intervals, F.lit(False))
    levels = max(1, (last - first) >> finest).bit_length()
    place = lambda t: F.call_function("shiftright", F.unix_micros(t) - first, F.lit(finest))
    p = points.filter(F.col(at).isNotNull()).select("*", F.inline(point_cells(place(F.col(at)), levels)))
    meets = (F.unix_micros(high) >= first) & (F.unix_micros(low) <= last) & (F.col(low) <= F.col(high))
    inside = interval_cells(F.greatest(place(F.col(low)), F.lit(0)), F.least(place(F.col(high)), F.lit((last - first) >> finest)), levels)
    i = intervals.filter(meets).select("*", F.inline(inside))
    return p.join(i, ["level", "cell"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("level", "cell")


def overlapping(periods: DataFrame, episodes: DataFrame, finest: int = FINEST) -> DataFrame:
    """Periods (start, end; an open end is far away) that overlap episodes (lo, hi: begins before hi, ends at lo or later), columns of both."""
    order = [*periods.columns, *episodes.columns]
    p = periods.withColumn("_end", F.coalesce("end", F.lit(_FAR).cast("timestamp")))
    over = holding(episodes, "lo", p, "start", "_end", finest).filter("start < hi")
    into = holding(p, "start", episodes, "lo", "hi", finest).filter("start > lo AND start < hi AND _end >= lo")
    return over.select(*order).unionByName(into.select(*order))
