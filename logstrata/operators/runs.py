"""Sorted runs: assignment, flush, manifest, replay and garbage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.functions.exprs import record_bytes
from logstrata.operators.lww import latest


def assign(log: DataFrame, per_run: int) -> DataFrame:
    """Rotation after a fixed count of mutations; no sort, no shuffle."""
    return log.withColumn("run_id", F.floor(F.col("seq") / per_run).cast("bigint"))


def flush(log: DataFrame, per_run: int) -> DataFrame:
    """One version of a key in each run, tombstones kept."""
    return latest(assign(log, per_run), "run_id")


def manifest(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_id").agg(
        F.count("*").alias("n_records"),
        F.sum(record_bytes(F.col("key"), F.col("value"))).alias("bytes"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
    )


def write_sorted(runs: DataFrame, path: str, parts: int, max_records: int = 0) -> None:
    """Runs as Parquet sorted by key: files and row groups then prune by their key bounds."""
    writer = runs.repartitionByRange(parts, "key").sortWithinPartitions("key").write
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def replay(runs: DataFrame, log: DataFrame) -> DataFrame:
    """State after recovery: published runs and the log that outlived them."""
    columns = ["seq", "op", "key", "value"]
    return latest(runs.select(*columns).unionByName(log.select(*columns)))


def collectable(retired: DataFrame, pinned: DataFrame) -> DataFrame:
    """Retired files that no reader holds."""
    return retired.join(pinned.select("tag"), "tag", "left_anti")
