"""Document placement through a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size (an offset and a skip
taken from hashes of its name; the prime size makes each order a permutation). Shards take turns,
each claiming its first free slot, until the table is full, so slot counts differ by one at most and
few slots change hands when a shard is added or removed. A document's key hashes to a slot, and the
table, broadcast, gives its shard in constant time.

Defined cases: a null key has the hash of the text 'null' prefixed by a byte no number has, so all
null keys go to one slot; equal keys always go to the same shard; an empty table gives an empty
result; no shards is an error. Columns named slot or shard in the input are left out of the result.

Scale: narrow; the table has ``size`` rows whatever the input (65,537 rows of two ints: about 1 MB),
which is the bound that allows its broadcast.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(name: str, what: str) -> int:
    return int(hashlib.md5(f"{what}:{name}".encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


@lru_cache(maxsize=16)
def lookup_table(shards: tuple[str, ...], size: int = TABLE_SIZE) -> np.ndarray:
    """slot -> index into ``shards``; shards claim slots in turns, each by its own order."""
    if not shards or len(set(shards)) < len(shards) or not is_prime(size) or size < len(shards):
        raise ValueError("distinct shards and a prime size of at least their number are needed")
    at = np.array([_hash(s, "offset") % size for s in shards])
    skip = np.array([_hash(s, "skip") % (size - 1) + 1 for s in shards])
    table = np.full(size, -1, dtype=np.int32)
    left = size
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    text = F.coalesce(key.cast("string"), F.lit("\u0001null"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with columns slot and shard."""
    table = lookup_table(tuple(shards), size)
    rows = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(table.tolist())], "slot int, shard string")
    keep = [c for c in df.columns if c not in ("slot", "shard")]
    return df.select(*[F.col(f"`{c}`") for c in keep], slot_of(F.col(f"`{key}`"), size).alias("slot")).join(F.broadcast(rows), "slot").select(
        *[F.col(f"`{c}`") for c in keep], "slot", "shard")


def digest(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "slot", "shard")
