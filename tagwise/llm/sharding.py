"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size,
an offset and a step derived from its name. Shards take turns: each claims the next
slot of its order that is still free, until the table is full. The table has almost
equally many slots for each shard, and a shard that joins or leaves moves little more
than its own share. The table is broadcast; a row's place is one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime well above a hundred times the usual number of shards; also the bound of the broadcast.
TABLE_SIZE = 65_537
MAX_TABLE_SIZE = 5_000_011


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's order: slot j of the order is (offset + j * step) mod size."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:15], 16) % size, int(digest[15:30], 16) % (size - 1) + 1


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number that holds each slot. A turn gives one slot to each shard; work and
    memory are bounded by ``size``, not by the data."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, and at least one")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE_SIZE:
        raise ValueError(f"the table's size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    orders = [preference(s, size) for s in shards]
    at = [offset for offset, _ in orders]
    table, left = [-1] * size, size
    while left:
        for i, (_, step) in enumerate(orders):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + step) % size
            table[slot] = i
            at[i] = (slot + step) % size
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A key's slot: 60 bits of its MD5, modulo the table's size; null is the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % size


def place(docs: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """All columns of ``docs`` with ``slot_col`` and ``shard_col`` (columns of these names are
    replaced). Rows with equal keys go to one shard; null keys are placed as the empty
    string. Rows are not moved or counted: a hot key costs nothing here."""
    spark = docs.sparkSession
    table = fill_table(shards, size)
    rows = spark.createDataFrame([(slot, shards[i]) for slot, i in enumerate(table)], f"`{slot_col}` long, `{shard_col}` string")
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (slot_col, shard_col)], slot_of(F.col(f"`{key_col}`"), size).alias(slot_col))
    joined = keyed.join(F.broadcast(rows), slot_col)
    return joined.select(*[F.col(f"`{c}`") for c in keyed.columns], F.col(f"`{shard_col}`"))
