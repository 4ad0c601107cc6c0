"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of one Arrow batch. Spark's own bound (64 MB) is held several times over, by the JVM and by a worker, for each task.
BATCH_BYTES = 8 << 20
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES; a lower one stays. A longer row is a batch of its own."""
    held = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if held > BATCH_BYTES or held <= 0:
        spark.conf.set(LIMIT, str(BATCH_BYTES))


def with_columns(docs: DataFrame, added: str, make: Callable, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` and the columns of the DDL string ``added``, which ``make(batch)`` gives as lists. Columns of those names are replaced; those in ``drop`` end in the worker."""
    bounded(docs.sparkSession)
    new = T._parse_datatype_string(added)
    names = {f.name for f in new.fields}
    base = docs.drop(*names)
    kept = [f for f in base.schema.fields if f.name not in drop]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new.fields]
        for batch in batches:
            columns = make(batch)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], *[pa.array(c, k) for c, k in zip(columns, kinds)]], [*[f.name for f in kept], *[f.name for f in new.fields]])

    return base.mapInArrow(run, T.StructType([*kept, *new.fields]))
