"""The binary form of runs and logs.

A record is flag (1 byte), key length, key, value length, value. A run is its
records in key order, cut into blocks that close at BLOCK_BYTES or more, then an
index entry a block (id, key length, last key, offset, size), then the footer
(index offset, index size, magic). Numbers are 8 bytes, little-endian.

Files are read by Spark's own binary source, so from any store that Spark
reaches; a file is one row, decoded in Arrow batches. A damaged file raises.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from struct import Struct, error

from pyspark.sql import DataFrame, SparkSession

MAGIC = 0x87654321  # fixed value of the format
BLOCK_BYTES = 65_535
U64, TRIPLE = Struct("<Q"), Struct("<QQQ")


def record(op: int, key: bytes, value: bytes | None) -> bytes:
    value = value or b""
    return bytes([op]) + U64.pack(len(key)) + key + U64.pack(len(value)) + value


def records(data: bytes, at: int = 0, end: int | None = None, cut: bool = False) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(op, key, value) of each record; a tombstone's value is null. With ``cut``, a last record that isn't whole ends them, as a crash leaves it."""
    end = len(data) if end is None else end

    def piece(at):
        start = at + 8
        stop = start + U64.unpack_from(data, at)[0]
        if stop > end:
            raise error(f"a length at byte {at} runs past the data")
        return data[start:stop], stop

    try:
        while at < end:
            op = data[at]
            key, at = piece(at + 1)
            value, at = piece(at)
            yield op, key, None if op == 1 else value
    except error as e:
        if not cut:
            raise ValueError(f"the last record is cut: {e}") from e


def encoded(rows: list[tuple[int, bytes, bytes | None]], first_id: int = 0, block_bytes: int = BLOCK_BYTES) -> bytes:
    """A run of rows (op, key, value), sorted here by key."""
    data, index, start, last = bytearray(), bytearray(), 0, None
    n = first_id

    def close():
        nonlocal start, n
        index.extend(U64.pack(n) + U64.pack(len(last)) + last + U64.pack(start) + U64.pack(len(data) - start))
        start, n = len(data), n + 1

    for op, key, value in sorted(rows, key=lambda r: r[1]):
        data += record(op, key, value)
        last = key
        if len(data) - start >= block_bytes:
            close()
    if start < len(data):
        close()
    return bytes(data + index + TRIPLE.pack(len(data), len(index), MAGIC))


def index_of(run: bytes) -> list[tuple[int, bytes, int, int]]:
    """(id, last key, offset, size) of each block."""
    if len(run) < TRIPLE.size:
        raise ValueError("no footer")
    at, size, magic = TRIPLE.unpack_from(run, len(run) - TRIPLE.size)
    if magic != MAGIC or at + size + TRIPLE.size != len(run):
        raise ValueError("not a run: wrong magic or index bounds")
    found, end = [], at + size
    while at < end:
        n, length = U64.unpack_from(run, at)[0], U64.unpack_from(run, at + 8)[0]
        key = run[at + 16 : at + 16 + length]
        offset, held = (U64.unpack_from(run, at + 16 + length + k)[0] for k in (0, 8))
        found.append((n, key, offset, held))
        at += 32 + length
    return found


def encode(runs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(run_id, content) of runs (run_id, op, key, value). A run is one task's work: cut large ones first (``blocks.split_files``)."""
    def one(table):
        import pyarrow as pa

        rows = [(op, k.encode(), None if v is None else v.encode()) for op, k, v in zip(*(table.column(c).to_pylist() for c in ("op", "key", "value")))]
        return pa.table({"run_id": pa.array([table.column("run_id")[0].as_py()], pa.int64()), "content": pa.array([encoded(rows, block_bytes=block_bytes)], pa.binary())})

    return runs.selectExpr("cast(run_id as bigint) run_id", "op", "key", "value").groupBy("run_id").applyInArrow(one, "run_id bigint, content binary")


def _decoded(files: DataFrame, parts) -> DataFrame:
    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                at, ops, keys, values, size, places = 0, [], [], [], 0, []
                made = lambda: pa.RecordBatch.from_arrays([pa.array([path] * len(ops)), pa.array(places, pa.int64()), pa.array(ops, pa.int8()), pa.array(keys, pa.string()), pa.array(values, pa.string())], ["path", "place", "op", "key", "value"])  # noqa: E731, B023
                for begin, end in parts(content):
                    for op, key, value in records(content, begin, end):
                        ops.append(op), keys.append(key.decode()), values.append(None if value is None else value.decode()), places.append(at)
                        at, size = at + 1, size + len(key) + len(value or b"")
                        if size > 1 << 22:
                            yield made()
                            ops, keys, values, size, places = [], [], [], 0, []
                if ops:
                    yield made()

    return files.select("path", "content").mapInArrow(read, "path string, place bigint, op tinyint, key string, value string")


def decode(files: DataFrame) -> DataFrame:
    """(path, place, op, key, value) of run files (path, content); every block is found by the index."""
    return _decoded(files, lambda content: [(offset, offset + size) for _, _, offset, size in index_of(content)])


def decode_log(files: DataFrame) -> DataFrame:
    """The same of log files: bare records in the order they were written, which is ``place``."""
    return _decoded(files, lambda content: [(0, len(content))])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.format("binaryFile").load(path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return decode_log(spark.read.format("binaryFile").load(path))


def get(run: bytes, key: bytes, index: list | None = None) -> tuple[int, bytes | None] | None:
    """(op, value) of a key in a run, or None. Footer and index tell the one block that can hold it; no other is decoded."""
    index = index_of(run) if index is None else index
    at = bisect_left(index, key, key=lambda entry: entry[1])
    if at == len(index):
        return None
    _, _, offset, size = index[at]
    return next(((op, value) for op, found, value in records(run, offset, offset + size) if found == key), None)


def lookup(files: DataFrame, probes: DataFrame) -> DataFrame:
    """(path, key, op, value) of each probe (path, key) of run files (path, content); op is null where the run hasn't the key.

    Probes meet their file; its index is read once, and then one block a probe.
    """
    def one(held, asked):
        import pyarrow as pa

        rows = []
        for content in held.column("content").to_pylist():
            index = index_of(content)
            for path, key in zip(asked.column("path").to_pylist(), asked.column("key").to_pylist()):
                op, value = get(content, key.encode(), index) or (None, None)
                rows.append((path, key, op, None if value is None else value.decode()))
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("path", pa.string()), ("key", pa.string()), ("op", pa.int8()), ("value", pa.string())))})

    return files.select("path", "content").groupBy("path").cogroup(probes.select("path", "key").groupBy("path")).applyInArrow(one, "path string, key string, op tinyint, value string")
