"""Adapters from tables to mutation logs: (seq BIGINT, op TINYINT, key STRING, value STRING)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "seq bigint, op tinyint, key string, value string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts and deletes: an error event deletes its user's key, any other sets it to the value in cents."""
    deleted = F.col("event_type") == "error"
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(deleted, 1).otherwise(0).cast("tinyint").alias("op"),
        F.col("user_id").cast("string").alias("key"),
        F.when(~deleted, cents).alias("value"),
    )


def orders_log(spark: SparkSession, sf_dir: str, value_bytes: int = 1000) -> DataFrame:
    """Insert-only log of unique keys with values of one length."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.lit(0).cast("tinyint").alias("op"),
        F.col("o_orderkey").cast("string").alias("key"),
        F.repeat(F.lit("8"), value_bytes).alias("value"),
    )
