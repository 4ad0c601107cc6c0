"""Streams of mutations: (seq BIGINT, op TINYINT, key STRING, value STRING)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from logstrata.operators.lww import latest
from logstrata.sources.tables import LOG_SCHEMA
from logstrata.store import Store


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of mutations as they arrive."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def live_state(stream: DataFrame) -> DataFrame:
    """The newest mutation of each key, kept as streaming state: one row a key, tombstones included. For update or complete mode."""
    return latest(stream)


def ingest(stream: DataFrame, store: Store, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch as one run of the store, once: the manifest names the last batch, so a batch that is replayed is left out.

    Later batches win over earlier ones, whatever their seq; inside a batch seq decides.
    """
    def one(batch: DataFrame, number: int) -> None:
        store.write(batch, (name, number))

    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(one).trigger(**(trigger or {"availableNow": True})).start()
