"""Placement of keys on shards by a lookup table that permutations fill in turns.

Every shard has its own order of preference over the slots of a table of prime size:
a start and a step from its hash, which visit all slots. Shards take turns; in its turn
a shard claims its next preferred slot that is still free, until all are taken. Slots
are thus spread evenly (counts differ by one at most), and when a shard comes or goes
few slots change hands. A key's slot is its hash modulo the table size, so placing a row
is one lookup in a broadcast table of fixed size. No row is shuffled.

Defined results: a null key has slot and shard null; equal keys share a shard; an empty
table gives no rows. The columns ``slot`` and ``shard`` are added under names that can
be chosen; all other columns stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

TABLE_SIZE = 2_039  # prime; more than a hundred slots for each of 16 shards
HEX_DIGITS = 15  # of md5: below 2 ** 60, so a long holds it


def key_hash(key: Column) -> Column:
    """A non-negative long from the key's text form, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, HEX_DIGITS), 16, 10).cast("long")


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:HEX_DIGITS], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For every slot the index of the shard that claimed it. ``size`` must be prime."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be prime")
    at = [_number(s, "start") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def place(docs: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """Add the key's slot and shard name."""
    if {slot, shard} & set(docs.columns):
        raise ValueError(f"docs already has a column {slot} or {shard}; choose other names")
    names = ",".join(map(str, fill_table(shards, size)))
    listed = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(names), ",")).alias(slot, "_k"))
    of = F.lit([s for s in shards])
    table = listed.select(F.col(slot).cast("long").alias(slot), F.get(of, F.col("_k").cast("int")).alias(shard))
    placed = docs.withColumn(slot, F.pmod(key_hash(F.col(key)), F.lit(size)))
    return placed.join(F.broadcast(table), slot, "left").select(*docs.columns, slot, shard)
