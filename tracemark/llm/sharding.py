"""Sharding with a permutation-filled lookup table (consistent hashing in constant time).

Every shard has its own permutation of the slots of a prime-sized table (an offset and a stride
drawn from its name).  The shards take turns; each claims the next free slot of its permutation
until the table is full.  All shards so own the same number of slots to within one, and adding or
removing a shard moves few keys besides its own.  Placement is one hash, one modulo and one lookup.

The table's size is a fixed parameter (``table_size`` slots), so its broadcast is bounded whatever
the data; the main path is DataFrame functions only and has no shuffle.

Defined cases: a null key hashes as the empty string; repeated keys go to the same shard; an empty
table gives an empty result; columns of the input that are called ``slot`` or ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 16381
MAX_TABLE_SIZE = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], table_size: int = TABLE_SIZE) -> list[int]:
    """The owner (index in ``shards``) of each slot."""
    if not _is_prime(table_size) or table_size > MAX_TABLE_SIZE:
        raise ValueError("table_size must be a prime of at most 2**20")
    if not shards or len(set(shards)) != len(shards) or len(shards) > table_size:
        raise ValueError("shards must be distinct, and between 1 and table_size")
    digest = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % table_size for d in digest]
    stride = [int.from_bytes(d[8:], "big") % (table_size - 1) + 1 for d in digest]
    owner = [-1] * table_size
    free = table_size
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + stride[k]) % table_size
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def slot_of(key: str, table_size: int = TABLE_SIZE):
    """The slot of a key: the first 48 bits of the MD5 of its text, modulo the table's size."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), F.lit(table_size)).cast("int")


def lookup_frame(spark: SparkSession, shards: list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """The table as a DataFrame (slot, shard) of exactly ``table_size`` rows."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, table_size)))), ",").cast("array<int>")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "shard"))


def assign_shards(docs: DataFrame, key: str, shards: list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with the columns slot and shard; a map-only plan."""
    placed = docs.drop("slot", "shard").withColumn("slot", slot_of(key, table_size))
    return placed.join(F.broadcast(lookup_frame(docs.sparkSession, shards, table_size)), "slot")
