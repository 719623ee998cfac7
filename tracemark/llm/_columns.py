"""The caller's columns, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name (dots and backticks are part of it)."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(df: DataFrame, *but: str) -> list[Column]:
    """All columns except ``but``."""
    return [named(c) for c in df.columns if c not in but]
