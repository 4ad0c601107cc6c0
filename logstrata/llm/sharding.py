"""Sharding by a permutation-filled lookup table.

Each shard ranks the slots of a prime-sized table by its own permutation
(offset and skip from its name); shards take turns claiming their next free
slot until the table is full. Shares then differ by one slot at most, and
adding or removing a shard moves little besides its own slots. Placement is a
hash, a remainder and one look into the broadcast table: no shuffle, and a key
of any weight costs no more than any other.

The table has ``slots`` rows, a parameter, so what is broadcast never grows
with the data. A null key is placed as the empty one, however many rows have it;
rows with equal keys share a shard, whatever else they hold, and long texts
aren't read; an empty table stays empty. Columns of the input are kept; slot and
shard replace any of that name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the place of its shard in ``shards``. Names must differ and be fewer than the slots; ``slots`` is prime."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, one at least, and no more than the slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    turn = sorted(range(len(shards)), key=lambda i: shards[i])  # the order of the list doesn't matter
    place = [_number(name, "offset") % slots for name in shards]
    skip = [1 + _number(name, "skip") % (slots - 1) for name in shards]
    table = [-1] * slots
    free = slots
    while free:
        for i in turn:
            while table[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % slots
            table[place[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % slots).cast("bigint")


def table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the driver's list as rows, split from one literal inside the JVM."""
    filled = ",".join(map(str, fill(shards, slots)))
    names = F.array(*map(F.lit, shards))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "place"))
    return rows.select(F.col("slot").cast("bigint").alias("slot"), F.get(names, F.col("place").cast("int")).alias("shard"))


def place(docs: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``docs`` with slot and shard."""
    keyed = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return keyed.join(F.broadcast(table(docs.sparkSession, shards, slots)), "slot").select(*[c for c in keyed.columns if c != "slot"], "slot", "shard")


def write(placed: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """One folder a shard, each written by ``files_per_shard`` tasks at least, so that a shard never meets in one task."""
    salt = F.pmod(F.xxhash64(*[c for c in placed.columns if c != "shard"]), F.lit(files_per_shard))
    placed.withColumn("_salt", salt).repartition("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)
