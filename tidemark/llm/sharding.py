"""Consistent sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lookup table is broadcast, so its size is bounded here.
MAX_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int) -> list[int]:
    """The shard number in each slot.

    A shard's preference list is ``(offset + j * skip) mod slots``; as ``slots`` is prime, that
    is a permutation. Shards take turns, each claiming its first slot that is still free, so
    shares differ by one slot at most, and a lost shard moves few keys of the others.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime between the number of shards and {MAX_SLOTS}")
    at = [_number(f"{s}/offset") % slots for s in shards]
    skip = [_number(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(min(len(shards), left)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
        left -= min(len(shards), left)
    return table


def slot_of(key: Column, slots: int) -> Column:
    """First 15 hex digits of the key's md5, modulo ``slots``; a null key counts as empty."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(slots).cast("bigint"))


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], slots: int = 4099) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (a name), replacing columns of those names.

    Every row is kept; rows with the same key, null included, go to the same shard. The lookup
    table has ``slots`` rows whatever the data, is broadcast, and nothing is shuffled. Keys are
    hashed, so hot sources and groups spread as long as ``key`` is a row id.
    """
    table = fill_table(shards, slots)
    names = F.array(*[F.lit(s) for s in shards])
    lookup = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("slot", "_n"))
    lookup = lookup.select(F.col("slot").cast("bigint").alias("slot"), F.element_at(names, F.col("_n").cast("int") + 1).alias("shard"))
    kept = df.select(*[c for c in df.columns if c not in ("slot", "shard")], slot_of(df[key], slots).alias("slot"))
    return kept.join(F.broadcast(lookup), "slot", "left").select(*[c for c in kept.columns if c != "slot"], "slot", "shard")
