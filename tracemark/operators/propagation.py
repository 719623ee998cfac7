"""Propagation of information units: who used it first, who took it up, how fast."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tracemark.operators.places import ranked
from tracemark.plans.storage import stored

# What counts as a unit.
URL = r"https?://[^\s<>\"'`)\]}]+"
FILE = r"\b[\w-]+(?:\.[\w-]+)*\.(?:py|mjs|js|tsx|ts|html|css|json|md|sh|ya?ml|csv|txt|svg|png)\b"
CODE = r"`([^`\n]{8,60})`"
SNAKE = r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
CAMEL = r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b"
SCREAM = r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"
TRAIL = ".,;:!?)]}\"'"
LEAST = 8
#: Adopters that a cascade lists; it counts all.
MOST_HOPS = 40
_PATTERNS = [(k, re.compile(p)) for k, p in (("url", URL), ("file", FILE), ("code", CODE), ("snake", SNAKE), ("camel", CAMEL), ("scream", SCREAM))]


def _unit(kind: str, text: str, m: re.Match) -> tuple[str, str] | None:
    """(key, raw) of a match, or None where it doesn't count."""
    if kind == "code":
        return m[1].strip().lower(), m[1]
    if kind == "url":
        raw = m[0].rstrip(TRAIL)
        key = re.split("[?#]", re.sub(r"^https?://(?:www\.)?", "", raw), maxsplit=1)[0].rstrip("/").lower()
        return (key, raw) if len(key) >= LEAST else None
    if len(m[0]) < LEAST or (kind == "file" and m.start() and text[m.start() - 1] in "/.%"):
        return None
    return (m[0].lower() if kind in ("file", "snake") else m[0]), m[0]


def units_of(text: str | None) -> list[dict]:
    """Each unit once, at its first place, in the order of the kinds."""
    found: dict[tuple[str, str], str] = {}
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text or ""):
            u = _unit(kind, text, m)
            if u:
                found.setdefault((kind, u[0]), u[1])
    return [{"kind": k, "unit": u, "raw": raw, "place": i} for i, ((k, u), raw) in enumerate(found.items())]




def _found(texts: pd.Series) -> pd.DataFrame:
    """(row, kind, unit, raw, place) of a batch of texts: each pattern walks once over all of them.

    The texts are joined by line feeds.  No pattern takes one in, and to all of them it is an end like any other.
    """
    texts = texts.fillna("").reset_index(drop=True)
    whole, begin = "\n".join(texts), np.cumsum([0, *(texts.str.len() + 1)])
    hits = [(rank, m.start(), kind, *u) for rank, (kind, p) in enumerate(_PATTERNS) for m in p.finditer(whole) if (u := _unit(kind, whole, m))]
    f = pd.DataFrame(hits, columns=["rank", "at", "kind", "unit", "raw"])
    f["row"] = np.searchsorted(begin, f["at"].to_numpy(np.int64), "right") - 1
    f = f.sort_values(["row", "rank", "at"], kind="stable").drop_duplicates(["row", "rank", "unit"])
    return f.assign(place=f.groupby("row").cumcount())[["row", "kind", "unit", "raw", "place"]]


def extract_units(rows: DataFrame, text: str = "text") -> DataFrame:
    """A row per unit of each text: the other columns of ``rows``, kind, unit, raw, place (0 the first of its text)."""
    keys = [c for c in rows.columns if c != text]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _found(batch.column(len(keys)).to_pandas())
            at = pa.array(f["row"].to_numpy(np.int64))
            more = [pa.array(f[c], kind) for c, kind in (("kind", pa.string()), ("unit", pa.string()), ("raw", pa.string()), ("place", pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *more], names=[*keys, "kind", "unit", "raw", "place"])

    schema = StructType([*rows.select(*keys).schema.fields, *[StructField(c, StringType()) for c in ("kind", "unit", "raw")], StructField("place", IntegerType())])
    return rows.select(*keys, text).mapInArrow(find, schema)


def trace(events: DataFrame, actors: DataFrame, source: str, *, start=None, end=None, subtypes=None, kinds=None, horizon_days: float = 7.0, min_adopters: int = 3, min_burst: float = 0.5, top: int | None = 50, most_hops: int = MOST_HOPS) -> DataFrame:
    """Cascades: unit, kind, origin, number of adopters, the first ``most_hops`` of them, uses, burst and upper median lag.

    Novelty looks at the whole history; [start, end) restricts the origins only.  The ``top`` largest come in
    order; with ``top`` None all of them, in none.
    """
    e = events.filter((F.col("source") == source) & F.col("text").isNotNull() & F.col("actor_id").isNotNull() & F.col("ts").isNotNull())
    e = e.filter(F.col("subtype").isin(*subtypes)) if subtypes else e
    uses = extract_units(e.select("ts", "event_id", "actor_id", "text"))
    return cascades(uses.filter(F.col("kind").isin(*kinds)) if kinds else uses, actors, start=start, end=end, horizon_days=horizon_days, min_adopters=min_adopters, min_burst=min_burst, top=top, most_hops=most_hops)


def cascades(uses: DataFrame, actors: DataFrame, *, start=None, end=None, horizon_days: float = 7.0, min_adopters: int = 3, min_burst: float = 0.5, top: int | None = 50, most_hops: int = MOST_HOPS) -> DataFrame:
    """The same from uses (kind, unit, ts, event_id, actor_id, raw, place).

    A unit may have any number of adopters: they are ranked by range parts, and a unit keeps the rows of its
    first hops and of its middle (lags rise with time, so the median lag is the middle adopter's).
    """
    unit = ["kind", "unit"]
    use = F.struct("ts", "event_id", "place", "actor_id", "raw")
    origin = uses.groupBy(*unit).agg(F.min(use).alias("origin"), F.count(F.lit(1)).alias("uses_total"))
    if start is not None:
        origin = origin.filter(F.col("origin.ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        origin = origin.filter(F.col("origin.ts") < F.lit(end).cast("timestamp"))
    inside = uses.join(origin, unit).filter(F.unix_micros("ts") - F.unix_micros("origin.ts") <= int(horizon_days * 86_400_000_000))
    by_actor = inside.groupBy(*unit, "origin", "uses_total", "actor_id").agg(F.min(use).alias("first"), F.count(F.lit(1)).alias("n"))
    by_actor = stored(uses.sparkSession, by_actor, "adopters")
    names = actors.select("actor_id", "display_name")
    c = by_actor.groupBy(*unit, "origin", "uses_total").agg(F.sum("n").alias("uses_in_horizon")).withColumn("actor_id", F.col("origin.actor_id"))
    c = c.join(names, "actor_id", "left").withColumn("origin_actor", F.coalesce("display_name", "actor_id")).drop("display_name", "actor_id")
    lag = F.round((F.unix_micros("first.ts") - F.unix_micros("origin.ts")) / 3.6e9, 2)
    hops = by_actor.filter(F.col("actor_id") != F.col("origin.actor_id")).select(*unit, "actor_id", "first.ts", "first.event_id", "first.raw", lag.alias("lag_hours"))
    hops = ranked(hops, unit, ["ts", "event_id", "actor_id"], "hop", "n_adopters")
    middle = F.col("hop") == F.floor(F.col("n_adopters") / 2) + 1
    hops = hops.filter((F.col("hop") <= most_hops) | middle).join(names, "actor_id", "left")
    hop = F.struct("ts", "event_id", F.coalesce("display_name", "actor_id").alias("actor"), "raw", "lag_hours")
    hops = hops.groupBy(*unit).agg(F.max("n_adopters").alias("n_adopters"), F.max(F.when(middle, F.col("lag_hours"))).alias("median_lag_hours"), F.sort_array(F.collect_list(F.when(F.col("hop") <= most_hops, hop))).alias("adopters"))
    c = c.join(hops, unit, "left").withColumn("n_adopters", F.coalesce("n_adopters", F.lit(0).cast("long"))).withColumn("adopters", F.coalesce("adopters", F.array()))
    share = F.col("uses_in_horizon") / F.col("uses_total")
    c = c.filter((F.col("n_adopters") >= min_adopters) & (share >= min_burst)).withColumn("burst", F.round(share, 3))
    if top is None:
        return c
    order = [F.desc("n_adopters"), F.coalesce("median_lag_hours", F.lit(0.0)), F.col("origin.ts"), F.col("origin.event_id"), F.col("origin.place")]
    return c.orderBy(*order).limit(top)


def first_uses(uses: DataFrame) -> DataFrame:
    """The first use of each unit by each actor."""
    w = Window.partitionBy("kind", "unit", "actor_id").orderBy("ts", "event_id", "place")
    return uses.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
