"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. The shards take turns; at its turn a shard
claims the first slot of its permutation that is still free, until the table is full. Shards then hold nearly equal
numbers of slots, and adding or removing one moves few others. A row's slot is its key's hash modulo the prime, and one
look into the broadcast table gives its shard.

Defined results: a null key hashes as the empty string; rows with equal keys share a shard; ties cannot arise (a slot
is claimed once); other columns are kept, columns named like the result's are replaced; very long keys are hashed whole;
an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The table is broadcast: 12 bytes an entry, so at most 50 MB.
MOST_SLOTS = 4_194_301


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], slots: int = 65_537) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(slots) or slots > MOST_SLOTS or slots < len(shards):
        raise ValueError(f"the number of slots must be a prime from the number of shards to {MOST_SLOTS}")
    place, step = [], []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        place.append(int.from_bytes(d[:8], "little") % slots)
        step.append(int.from_bytes(d[8:16], "little") % (slots - 1) + 1)
    table, free = [-1] * slots, slots
    while True:
        for shard in range(len(shards)):
            at = place[shard]
            while table[at] >= 0:
                at = (at + step[shard]) % slots
            table[at] = shard
            place[shard] = (at + step[shard]) % slots
            free -= 1
            if not free:
                return table


def place(df: DataFrame, key_col: str, shards: Sequence[str], slots: int = 65_537) -> DataFrame:
    """``df`` with slot (int), shard (int) and shard_name (string)."""
    spark = df.sparkSession
    table = fill(shards, slots)
    schema = T.StructType([T.StructField("slot", T.IntegerType(), False), T.StructField("shard", T.IntegerType(), False), T.StructField("shard_name", T.StringType(), False)])
    lookup = spark.createDataFrame([(i, s, shards[s]) for i, s in enumerate(table)], schema)
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit(""))), F.lit(slots)).cast("int")
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard", "shard_name")]
    return df.select(hashed.alias("slot"), *[F.col(f"`{c}`") for c in kept]).join(F.broadcast(lookup), "slot").select(*[F.col(f"`{c}`") for c in kept], "slot", "shard", "shard_name")


def write_shards(df: DataFrame, path: str, key_col: str, shards: Sequence[str], slots: int = 65_537) -> None:
    """Write ``df`` as Parquet with one folder per shard; each task writes only the shards of its slots.

    Rows of one slot are ordered by a hash of the whole row, so that a hot key's shard is written by several tasks.
    """
    placed = place(df, key_col, shards, slots)
    plain = [F.col(f"`{f.name}`") for f in placed.schema.fields if "map<" not in f.dataType.simpleString()]
    placed.repartitionByRange("shard", "slot", F.xxhash64(*plain)).write.partitionBy("shard").parquet(path)
