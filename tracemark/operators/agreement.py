"""Agreement between raters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and Cohen's kappa of two boolean verdicts; 1 where chance alone agrees always."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    m = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    k = F.when(chance == 1, 1.0).otherwise((F.col("po") - chance) / (1 - chance))
    return m.select("n", F.round("po", 4).alias("agreement"), F.round(k, 4).alias("kappa"))


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def compare_audits(one: DataFrame, two: DataFrame, key: list[str], verdict: str) -> DataFrame:
    """(matched, only_one, only_two, agreed): inner matches and the rest of either side, one row."""
    x = one.select(*key, F.col(verdict).alias("_x"), F.lit(True).alias("_1"))
    y = two.select(*key, F.col(verdict).alias("_y"), F.lit(True).alias("_2"))
    j = x.join(y, key, "full")
    both = F.col("_1").isNotNull() & F.col("_2").isNotNull()
    return j.agg(F.count_if(both).alias("matched"), F.count_if(F.col("_2").isNull()).alias("only_one"), F.count_if(F.col("_1").isNull()).alias("only_two"), F.count_if(both & (F.col("_x") == F.col("_y"))).alias("agreed"))
