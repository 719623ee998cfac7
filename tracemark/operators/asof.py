"""As-of lookups without pairs: points and items sorted together, with a state that is carried on.

Points and items of equal keys are merged in order of time by one sort by range.  A running window inside
each part finds what a point needs of its own part; what the other parts hold of a group is one state per
part and group, and running windows over that small table carry it on.  So each row takes part once,
however many items a point could have met, and a key that holds a third of all rows lies in many parts.

A point without a key or time finds nothing; items without one, or of no agent, are never found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemark.operators.places import earlier, sorted_parts, with_part_figures


def _merged(points: DataFrame, items: DataFrame, keys: list[str], at: str, points_first: bool) -> DataFrame:
    """Sorted parts of both; ``_item`` is a struct of the item's columns, null for a point."""
    p = points.filter(F.col(at).isNotNull()).withColumn("_turn", F.lit(0 if points_first else 1))
    i = items.select(*keys, at, F.lit(1 if points_first else 0).alias("_turn"), F.struct(*[c for c in items.columns if c not in keys]).alias("_item"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = p.unionByName(i.filter(F.col(at).isNotNull()), allowMissingColumns=True).filter(known)
    return sorted_parts(rows, keys, [at, "_turn"])


def next_item(points: DataFrame, items: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``points`` (keys, at, ...) with ``item``: the first item (keys, at, ...) that isn't before the point, a struct; those that find none are left out."""
    table = _merged(points, items, keys, at, points_first=True)
    onwards = Window.partitionBy("_part", *keys).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumn("_own", F.last("_item", ignorenulls=True).over(onwards))
    parts = table.groupBy("_part", *keys).agg(F.min_by("_item", F.when(F.col("_item").isNotNull(), F.col("_at"))).alias("_first"))
    parts = parts.withColumn("_next", F.last("_first", ignorenulls=True).over(earlier(keys, F.desc("_part"))))
    found = with_part_figures(table.filter("_item IS NULL"), parts, keys).withColumn("item", F.coalesce("_own", "_next"))
    return found.filter("item IS NOT NULL").select(*points.columns, "item")


def items_before(points: DataFrame, items: DataFrame, keys: list[str], at: str, inclusive: bool = True) -> DataFrame:
    """``points`` with ``n_items``: how many items of its keys lie before the point (or at it, if inclusive)."""
    table = _merged(points, items, keys, at, points_first=not inclusive)
    upto = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumn("_own", F.count("_item").over(upto))
    parts = table.groupBy("_part", *keys).agg(F.count("_item").alias("_n"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier(keys, "_part")), F.lit(0)))
    found = with_part_figures(table.filter("_item IS NULL"), parts, keys)
    return found.select(*points.columns, (F.col("_own") + F.col("_before")).alias("n_items"))


def running(points: DataFrame, items: DataFrame, keys: list[str], at: str, counts: dict[str, Column], greatest: dict[str, Column]) -> DataFrame:
    """``points`` with figures of the items of its keys up to the point: how many fulfil each condition of ``counts``, and the greatest of each column of ``greatest``."""
    both = [(k, F.sum) for k in counts] + [(k, F.max) for k in greatest]
    i = items.select(*keys, at, *[F.when(c, 1).otherwise(0).cast("long").alias(k) for k, c in counts.items()], *[c.alias(k) for k, c in greatest.items()])
    table = _merged(points, i, keys, at, points_first=False)
    upto = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    table = table.select("*", *[f(F.col("_item")[k]).over(upto).alias(f"_own_{k}") for k, f in both])
    parts = table.groupBy("_part", *keys).agg(*[f(F.col("_item")[k]).alias(f"_all_{k}") for k, f in both])
    parts = parts.select("_part", *keys, *[f(f"_all_{k}").over(earlier(keys, "_part")).alias(f"_before_{k}") for k, f in both])
    found = with_part_figures(table.filter("_item IS NULL"), parts, keys)
    zero = F.lit(0).cast("long")
    total = [(F.coalesce(f"_own_{k}", zero) + F.coalesce(f"_before_{k}", zero)).alias(k) for k in counts]
    return found.select(*points.columns, *total, *[F.array_max(F.array(f"_own_{k}", f"_before_{k}")).alias(k) for k in greatest])


def _last_two(rows: DataFrame, group: list[str], order: list[str], agent: str, last: str, other: str) -> DataFrame:
    """``rows`` with the last ``_item`` so far and the last one of another agent than that."""
    before = earlier(group, *order)
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_previous", F.last("_item", ignorenulls=True).over(before))
    rows = rows.withColumn("_handed", F.when(F.col(f"_previous.{agent}") != F.col(f"_item.{agent}"), F.col("_previous")))
    rows = rows.withColumn(last, F.last("_item", ignorenulls=True).over(upto)).withColumn(other, F.last("_handed", ignorenulls=True).over(upto))
    return rows.drop("_previous", "_handed")


def last_of_others(points: DataFrame, items: DataFrame, keys: list[str], at: str, agent: str) -> DataFrame:
    """``points`` (keys, at, agent, ...) with ``item``: the last item up to the point that another agent has; those that find none are left out.

    The state is the last item and the last one of another agent than its own: one of the two is by another
    agent than the point's, whoever that is.
    """
    table = _merged(points, items.filter(F.col(agent).isNotNull()), keys, at, points_first=False)
    table = _last_two(table, ["_part", *keys], ["_at"], agent, "_last", "_other")
    ends = table.groupBy("_part", *keys).agg(F.max_by(F.struct("_last", "_other"), "_at").alias("_end"))
    # the states of the parts as a sequence: where the part begins (no item), then its two items in order of time
    nothing = F.lit(None).cast(table.schema["_item"].dataType)
    steps = [F.struct(F.lit(k).alias("_step"), x.alias("_item")) for k, x in enumerate((nothing, F.col("_end._other"), F.col("_end._last")))]
    steps = ends.select("_part", *keys, F.inline(F.array(*steps)))
    carried = _last_two(steps, keys, ["_part", "_step"], agent, "_last_before", "_other_before").filter("_step = 0").drop("_step", "_item")
    found = with_part_figures(table.filter("_item IS NULL"), carried, keys)
    items_ = [F.when(F.col(f"{c}.{agent}") != F.col(agent), F.col(c)) for c in ("_last", "_other", "_last_before", "_other_before")]
    return found.withColumn("item", F.coalesce(*items_)).filter("item IS NOT NULL").select(*points.columns, "item")
