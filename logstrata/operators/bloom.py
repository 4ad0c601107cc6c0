"""Bloom filters: as relations of set bits, and as bitmaps that are stored and probed."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.exprs import hash_slice

BUCKET_BITS = 32_768  # of one bitmap row


def positions(key: Column, n_bits: int, n_hashes: int = 3) -> Column:
    """Bit positions by double hashing: (h1 + i * h2) mod bits, an array of i and pos."""
    h1, h2 = hash_slice(key, 1), hash_slice(key, 8)
    return F.transform(F.sequence(F.lit(0), F.lit(n_hashes - 1)), lambda i: F.struct(i.alias("i"), ((h1 + i * h2) % n_bits).alias("pos")))


def positions_of(key: str, n_bits: int, n_hashes: int = 3) -> list[int]:
    """The same for one key on the driver."""
    digest = hashlib.md5(key.encode()).hexdigest()
    h1, h2 = int(digest[:7], 16), int(digest[7:14], 16)
    return [(h1 + i * h2) % n_bits for i in range(n_hashes)]


def exploded(keys: DataFrame, n_bits: int, n_hashes: int = 3) -> DataFrame:
    rows = keys.select("key", F.explode(positions(F.col("key"), n_bits, n_hashes)).alias("p"))
    return rows.select("key", F.col("p.i").cast("int").alias("i"), F.col("p.pos").alias("pos"))


def build(keys: DataFrame, n_bits: int, n_hashes: int = 3) -> DataFrame:
    """(bucket, bits): the set bits, packed, one bitmap row per bucket of bits, with partial aggregation. Bit 0 of a bucket is its lowest position."""
    bits = exploded(keys, n_bits, n_hashes)
    return bits.groupBy(F.floor(F.col("pos") / BUCKET_BITS).cast("bigint").alias("bucket")).agg(F.bitmap_construct_agg(F.col("pos") % BUCKET_BITS).alias("bits"))


def union(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of filters of one size."""
    rows = filters[0]
    for more in filters[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def save(bitmaps: DataFrame, path: str) -> None:
    bitmaps.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket bigint, bits binary").parquet(path)


def probe_stored(bitmaps: DataFrame, probes: DataFrame, n_bits: int, n_hashes: int = 3) -> DataFrame:
    """may_exist of each probe by the bitmaps: all of its bits are set."""
    asked = exploded(probes.select("key").distinct(), n_bits, n_hashes).withColumn("bucket", F.floor(F.col("pos") / BUCKET_BITS).cast("bigint"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(pos % 32768 as int) div 8 + 1, 1)")), 16, 10).cast("int")
    is_set = F.coalesce(F.expr("bits is not null") & (byte.bitwiseAND(F.expr("shiftleft(1, cast(pos % 8 as int))")) != 0), F.lit(False))
    return asked.join(bitmaps, "bucket", "left").groupBy("key").agg((F.count_if(is_set) == n_hashes).alias("may_exist"))


def probe(keys: DataFrame, probes: DataFrame, n_bits: int, n_hashes: int = 3) -> DataFrame:
    """may_exist of each probe: all of its bits are set. Never false for a key of the filter."""
    bits = exploded(keys, n_bits, n_hashes).select("pos").distinct()
    asked = exploded(probes.select("key").distinct(), n_bits, n_hashes)
    found = asked.join(bits.withColumn("hit", F.lit(1)), "pos", "left")
    return found.groupBy("key").agg((F.count("hit") == n_hashes).alias("may_exist"))
