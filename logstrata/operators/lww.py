"""Last-write-wins state of a mutation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, *more_keys: str) -> DataFrame:
    """The newest mutation of each key (and of ``more_keys``), tombstones included.

    One aggregate with partial aggregation before its shuffle, so a hot key
    sends one row per task. The value travels with its operation in a struct:
    a null value of the newest mutation must not be skipped. A filter on the
    key is pushed below the shuffle; one on op or value stays above it.
    """
    newest = F.max_by(F.struct("op", "value"), "seq").alias("newest")
    grouped = log.groupBy(*more_keys, "key").agg(newest, F.max("seq").alias("seq"))
    return grouped.select(*more_keys, "key", F.col("newest.op").alias("op"), F.col("newest.value").alias("value"), "seq")


def snapshot(log: DataFrame) -> DataFrame:
    """Live keys and their values. Tombstones go only after the newest mutation is known."""
    return latest(log).filter("op = 0").select("key", "value")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """Live keys as they were after mutation ``seq``."""
    return snapshot(log.filter(F.col("seq") <= seq))
