"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD_OVERHEAD = 17  # flag byte and two 8-byte lengths
INDEX_OVERHEAD = 32  # id, length, offset and size of an index entry, 8 bytes each
FOOTER_BYTES = 24


def record_bytes(key: Column, value: Column) -> Column:
    """Encoded bytes of a record; lengths are bytes, not characters. A null value counts 0."""
    return (F.lit(RECORD_OVERHEAD) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("bigint")


def index_bytes(key: Column) -> Column:
    return (F.lit(INDEX_OVERHEAD) + F.octet_length(key)).cast("bigint")


def hash_slice(key: Column, start: int) -> Column:
    """28 bits of md5(key) from hex digit ``start`` on: small enough that no later arithmetic overflows."""
    return F.conv(F.substring(F.md5(key), start, 7), 16, 10).cast("bigint")


def status(found_op: Column) -> Column:
    """FOUND, DELETED or NOT_FOUND of a left-joined operation flag."""
    return F.when(found_op.isNull(), "NOT_FOUND").when(found_op == 1, "DELETED").otherwise("FOUND")
