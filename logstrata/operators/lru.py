"""LRU caches as queries over an access trace (seq, key) in which every access loads its key."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logstrata.plans.durable import written

BLOCK = 8192


def _states(trace: DataFrame, capacity: int, blocks: int) -> DataFrame:
    """(block, key, seq): what the cache holds before each block, ``capacity`` rows a block at most.

    A block's own last accesses are merged with those of the block before, then
    of two before, four before and so on, and cut to the cache's size each time.
    """
    def newest(rows: DataFrame) -> DataFrame:
        once = rows.groupBy("block", "key").agg(F.max("seq").alias("seq"))
        rank = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("seq")))
        return once.withColumn("_rank", rank).filter(F.col("_rank") <= capacity).drop("_rank")

    last = F.lit(blocks - 1)
    state = written(newest(trace.select((F.col("block") + 1).alias("block"), "key", "seq").filter(F.col("block") <= last)), "state")
    step = 1
    while step < blocks:
        moved = state.select((F.col("block") + step).alias("block"), "key", "seq").filter(F.col("block") <= last)
        state = written(newest(state.unionByName(moved)), "state")
        step *= 2
    return state


def hits(trace: DataFrame, capacity: int, block: int = BLOCK) -> DataFrame:
    """hit of each access: its key was in the cache. ``seq`` is unique and not null.

    The trace is replayed in blocks of ``block`` consecutive sequence numbers, each from the cache's state before it:
    linear in the trace, and no task holds more than a block and a cache.
    """
    block = max(block, 4 * capacity)
    least, most = trace.agg(F.min("seq"), F.max("seq")).first()
    if least is None:
        return trace.select("seq", "key", F.lit(False).alias("hit"))
    numbered = trace.select(F.floor((F.col("seq") - least) / block).cast("bigint").alias("block"), "seq", "key")
    kind = trace.schema["key"].dataType.simpleString()

    def replay(own, held):
        import pyarrow as pa

        by_seq = lambda t: t.sort_by("seq")
        cache = OrderedDict((k, None) for k in by_seq(held).column("key").to_pylist())
        own, found = by_seq(own), []
        for key in own.column("key").to_pylist():
            found.append(key in cache)
            cache[key] = None
            cache.move_to_end(key)
            if len(cache) > capacity:
                cache.popitem(last=False)
        return pa.table({"seq": own.column("seq"), "key": own.column("key"), "hit": pa.array(found, pa.bool_())})

    state = _states(numbered, capacity, (most - least) // block + 1)
    return numbered.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(replay, f"seq {trace.schema['seq'].dataType.simpleString()}, key {kind}, hit boolean")


def contents(trace: DataFrame, capacity: int) -> DataFrame:
    """Keys that the cache holds at the end."""
    return trace.groupBy("key").agg(F.max("seq").alias("last_seq")).orderBy(F.desc("last_seq")).limit(capacity)


def size(trace: DataFrame, capacity: int) -> DataFrame:
    """One row: accesses, distinct keys, and how many of them the cache holds at the end."""
    keys = trace.groupBy("key").agg(F.count("*").alias("n"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("accesses"), F.count("*").alias("keys"), F.least(F.count("*"), F.lit(capacity).cast("bigint")).alias("size"))
