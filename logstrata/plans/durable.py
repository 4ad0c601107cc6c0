"""Cutting a plan's lineage where every executor can read the result again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: the files of its shuffles go when it is there. A lost executor's later reads find the table.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
FULL = 0.4  # of the driver's heap


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where it is unset and everything runs in one process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="logstrata-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextmanager
def settings(spark: SparkSession, held: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block; what was there before comes back."""
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str = "table", **held: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: column pruning still works on it, and lost executors lose nothing.

    ``held`` are session settings for the time of the write, their dots as double underscores.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, CLEANED | {k.replace("__", "."): v for k, v in held.items()}):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def stored_bytes(table: DataFrame) -> int:
    """What a table that written() has made takes in the shared folder."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def small(table: DataFrame, rows: int = 2_000_000, stored: int = 16 << 20) -> DataFrame:
    """A written table, to be broadcast where both its rows and its bytes allow it; else Spark joins by shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(table) if stored_bytes(table) <= stored and table.count() <= rows else table


def eased(spark: SparkSession) -> None:
    """Collects the driver's garbage where it uses more than FULL of its heap: plans, broadcasts and generated code of finished steps, which else stay until the heap has grown to its bound."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > FULL * heap.maxMemory():
        spark._jvm.java.lang.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() has made. Nothing that is still to run may read them."""
    if tables:
        eased(tables[0].sparkSession)
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


materialize = written
