"""Merging runs and planning which to merge."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.operators.lww import latest

LEVEL_CAPS = (8, 80, 800, 8000, 80000)  # fixed values: files that each level holds
FAN_IN = 8


def merge_two(older: DataFrame, newer: DataFrame, *group: str) -> DataFrame:
    """Ordered union of two runs; at equal keys the newer entry wins, even as a tombstone with a null value. Runs of one ``group`` meet only."""
    o = older.select(*group, "key", F.struct("op", "value").alias("o"))
    n = newer.select(*group, "key", F.struct("op", "value").alias("n"))
    picked = F.coalesce("n", "o")
    source = F.when(F.col("n").isNull(), "older").when(F.col("o").isNull(), "newer").otherwise("both")
    return o.join(n, [*group, "key"], "full_outer").select(*group, "key", picked["op"].alias("op"), picked["value"].alias("value"), source.alias("source"))


def merge(runs: DataFrame, *group: str) -> DataFrame:
    """Any number of runs in one pass: a union and one aggregate instead of a tree of pairwise merges. Runs of one ``group`` merge with each other only."""
    return latest(runs, *group)


def grouped(runs: DataFrame) -> DataFrame:
    """Adds group_id: FAN_IN consecutive runs are one merge; the last group may have fewer."""
    return runs.withColumn("group_id", F.floor(F.col("run_id") / FAN_IN).cast("bigint"))


def group_stats(runs: DataFrame) -> DataFrame:
    """Records read, written and overwritten, and tombstones left, of every merge of grouped()."""
    keys = grouped(runs).groupBy("group_id", "key").agg(F.count("*").alias("n"), F.max_by("op", "seq").alias("op"))
    return keys.groupBy("group_id").agg(
        F.sum("n").alias("input_records"), F.count("*").alias("output_records"), (F.sum("n") - F.count("*")).alias("overwritten"),
        F.count_if(F.col("op") == 1).alias("tombstones"))


@dataclass
class Levels:
    """File counts by level under the tiered policy. Planning only: it never touches data."""

    files: list[int] = field(default_factory=lambda: [0] * len(LEVEL_CAPS))
    merges: int = 0

    def flush(self) -> bool:
        """Room for one more run in level 0, made by a cascade if need be; False where every level is full."""
        if self.files[0] >= LEVEL_CAPS[0]:
            target = next((i for i in range(1, len(LEVEL_CAPS)) if self.files[i] + FAN_IN <= LEVEL_CAPS[i]), None)
            if target is None:
                return False
            for level in range(target, 0, -1):
                self.files[level - 1] -= FAN_IN
                self.files[level] += FAN_IN
                self.merges += 1
        self.files[0] += 1
        return True


def simulate(flushes: int) -> Levels:
    """The levels after so many flushes. A store whose levels are all full refuses every later one, so the loop ends with the caps, whatever ``flushes`` is."""
    levels = Levels()
    for _ in range(flushes):
        if not levels.flush():
            break
    return levels
