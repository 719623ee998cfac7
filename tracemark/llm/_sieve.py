"""A semi-join filter of fixed size: most rows without a partner never reach the shuffle.

The wanted keys set bits of a bitmap of 2**BITS bits, kept as rows of 4 KB; rows whose bit isn't set
have no partner.  The broadcast is 8 MB at most whatever the data.  As the keys grow the filter only
lets more rows pass; a join behind it decides.

The rows may have columns of any names: the key goes first into a column of a drawn name, and so does all
that is added for the lookup.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.llm._columns import every

BITS = 26
_ROW = 15


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITS))


def _marked(rows: DataFrame, wanted: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, Column]:
    (only,) = wanted.columns if len(wanted.columns) == 1 else keys
    where = wanted.select(F.shiftright(_slot(F.col(only)), _ROW).alias("part"), _slot(F.col(only)).bitwiseAND((1 << _ROW) - 1).alias("bit"))
    bitmap = where.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    hits, out = [], rows
    for key in keys:
        drawn = uuid.uuid4().hex
        part, map_ = f"part_{drawn}", f"map_{drawn}"
        bit = _slot(F.col(key)).bitwiseAND((1 << _ROW) - 1).cast("int")
        byte = F.conv(F.hex(F.substring(map_, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        hits.append(F.coalesce(F.call_function("shiftright", byte, bit.bitwiseAND(7)).bitwiseAND(1) == 1, F.lit(False)))
        out = out.withColumn(part, F.shiftright(_slot(F.col(key)), _ROW)).join(F.broadcast(bitmap.select(F.col("part").alias(part), F.col("map").alias(map_))), part, "left")
    return out, reduce(Column.__or__, hits)


def may_match(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows of which one of ``keys`` may be among those of ``wanted``; all that are, and few others."""
    marked, hit = _marked(rows, wanted, keys)
    return marked.filter(hit).select(*every(rows))


def no_match(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The other rows."""
    marked, hit = _marked(rows, wanted, keys)
    return marked.filter(~hit).select(*every(rows))
