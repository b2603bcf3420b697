"""Shard placement by a permutation-filled lookup table, DataFrame functions only.

Every shard has its own order of preference over the slots of a table of prime size; in turn,
each shard claims the first free slot of its order until the table is full.  Slots are thus
shared out evenly (counts differ by one at most) and a shard added or removed moves few others.
A document hashes to a slot, and a broadcast of the table - ``table_size`` rows, whatever the
number of documents - gives its shard in constant time, without a shuffle.

Defined cases: a null key is the empty key; equal keys share a shard; repeated rows stay; empty
tables are fine; ``place`` adds one column and keeps all others as they are, replacing a column
that already has its name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caremart.llm.common import md5_long

SHARDS = 64
SLOTS_PER_SHARD = 100


def table_size(shards: int, per_shard: int = SLOTS_PER_SHARD) -> int:
    """The smallest prime of at least ``per_shard`` slots for each shard."""
    n = max(3, shards * per_shard)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], size: int) -> list[int]:
    """Index of the shard that owns each slot."""
    if not names or len(set(names)) != len(names) or size < len(names):
        raise ValueError("shards need distinct names and at least one slot each")
    offset = [_number(f"offset|{n}") % size for n in names]
    skip = [_number(f"skip|{n}") % (size - 1) + 1 for n in names]
    owner, tried = [-1] * size, [0] * len(names)
    for turn in range(size):
        i = turn % len(names)
        while owner[slot := (offset[i] + tried[i] * skip[i]) % size] >= 0:
            tried[i] += 1
        owner[slot] = i
    return owner


def slot_of(key: Column, size: int) -> Column:
    return F.pmod(md5_long(F.coalesce(key.cast("string"), F.lit(""))), F.lit(size)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", names: list[str] | None = None,
          size: int | None = None, column: str = "shard") -> DataFrame:
    """All columns of ``docs`` and ``column``: the name of the shard that holds the row."""
    names = names or [f"shard-{i:03d}" for i in range(SHARDS)]
    size = size or table_size(len(names))
    owners = lookup_table(names, size)
    kept = [c for c in docs.columns if c != column]
    table = docs.sparkSession.createDataFrame(
        [(slot, names[i]) for slot, i in enumerate(owners)], "slot int, shard string").repartition(1)
    packed = docs.select(slot_of(F.col(f"`{key}`"), size).alias("slot"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    return (packed.join(F.broadcast(table), "slot")
            .select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("shard").alias(column)))
