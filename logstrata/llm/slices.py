"""Whole texts as slices, and counts of their tokens over the corpus asked and answered by slice.

``sliced`` writes the texts once, some MB a row, under names that never change
afterwards: a second pass finds the same slices, whatever the input was (files,
a shuffle, rows in memory) and whatever the session's Arrow settings are.

A slice asks each partition of the hash space for the counts of its distinct
tokens, in one message, so a token that is everywhere is one entry a slice.
``counted`` answers each message in the order of its tokens. A message holds a
token at least, so messages never outnumber the tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.llm import hashing
from logstrata.llm.arrow import BATCH_BYTES
from logstrata.plans.durable import written

SLICE = 2 << 20  # bytes of text; a longer text is a slice of its own
PARTITION = 16 << 20  # bytes of text for each partition of the hash space
SMALL = {"spark__sql__execution__arrow__maxBytesPerBatch": str(BATCH_BYTES), "spark__sql__execution__arrow__maxRecordsPerBatch": "2000"}
ONE = SMALL | {"spark__sql__execution__arrow__maxRecordsPerBatch": "4"}  # rows that are slices


def sliced(docs: DataFrame) -> DataFrame:
    """(slice, bytes, ids, sizes, blob) of docs (doc_id, _text), written; null texts are empty."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        packer, name, ids, held, size = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32, [], [], 0

        def made():
            column = pa.chunked_array(ids).combine_chunks()
            column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), pa.array([size], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column),
                 pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([packer.compress(b"".join(held))], pa.binary())],
                ["slice", "bytes", "ids", "sizes", "blob"])

        for batch in batches:
            names, begin = batch.column("doc_id"), 0
            for i, text in enumerate(hashing.texts_of(batch.column("_text"))):
                if held and size + len(text) > SLICE:
                    if i > begin:
                        ids.append(names.slice(begin, i - begin))
                    yield made()
                    name, ids, held, size, begin = name + 1, [], [], 0, i
                held.append(text)
                size += len(text)
            if batch.num_rows > begin:
                ids.append(names.slice(begin))
        if held:
            yield made()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", "_text").mapInArrow(run, f"slice bigint, bytes bigint, ids array<{kind}>, sizes array<bigint>, blob binary"), "slices", **SMALL)


def texts(row_sizes, blob: bytes) -> list[bytes]:
    """The texts of a slice."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob) if blob else b""
    ends = np.cumsum([0, *row_sizes])
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:])]


def packed(counts) -> bytes:
    """Counts in the smallest unsigned type that holds them, after its size."""
    kind = np.min_scalar_type(int(counts.max()) if len(counts) else 0)
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def unpacked(data: bytes):
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class Plan:
    """How many partitions the hash space has, and how many bytes of a hash tell tokens apart: both follow the size of the corpus.

    ``spare`` bits more than the corpus has bytes are kept, 2**spare hash values for each byte.
    """

    def __init__(self, slices: DataFrame, spare: int):
        size = slices.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        self.bits = max(4, int(np.ceil(np.log2(max(1, size / PARTITION)))))
        self.width = min(8, max(4, int(np.ceil((np.log2(max(2, size)) + spare) / 8))))

    def keys(self, tokens):
        return tokens >> np.uint64(64 - 8 * self.width)

    def asked(self, tokens):
        """(sorted distinct keys, their counts, (part, first, last) of each message) of the tokens of a slice."""
        keys, counts = np.unique(self.keys(tokens), return_counts=True)
        owner = (keys >> np.uint64(8 * self.width - self.bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        return keys, counts, [(int(owner[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(keys)])]

    def squeezed(self, keys) -> bytes:
        return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, : self.width]).tobytes()

    def spread(self, data: bytes):
        raw = np.frombuffer(data, np.uint8).reshape(-1, self.width)
        out = np.zeros((len(raw), 8), np.uint8)
        out[:, : self.width] = raw
        return out.view(np.uint64).ravel()


def requests(slices: DataFrame, plan: Plan, tokens: Callable) -> DataFrame:
    """(slice, kind, part, keys, counts). ``tokens(texts)`` yields (kind, hashes of all occurrences) of a slice."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, sizes, blob in zip(*(batch.column(c).to_pylist() for c in ("slice", "sizes", "blob"))):
                rows = []
                for kind, found in tokens(texts(sizes, blob)):
                    keys, counts, messages = plan.asked(found)
                    rows += [(name, kind, part, plan.squeezed(keys[a:b]), packed(counts[a:b])) for part, a, b in messages]
                for i in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 512]), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["slice", "kind", "part", "keys", "counts"])

    return slices.select("slice", "sizes", "blob").mapInArrow(run, "slice bigint, kind int, part bigint, keys binary, counts binary")


def counted(asked: DataFrame, plan: Plan) -> DataFrame:
    """(slice, kind, part, counts, own) of each message: the sums over all slices, and what the message itself has. The counts of a partition of the hash space are one task's work at a time."""
    def count(table):
        import pyarrow as pa

        keys = [plan.spread(x.as_py()) for x in table.column("keys")]
        counts = [unpacked(x.as_py()) for x in table.column("counts")]
        _, places = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(places, weights=np.concatenate(counts))[places].astype(np.int64)
        cuts = np.cumsum([0] + [len(k) for k in keys])
        return pa.table({"slice": table.column("slice"), "kind": table.column("kind"), "part": table.column("part"), "counts": pa.array([packed(sums[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()), "own": pa.array([int(x.sum()) for x in counts], pa.int64())})

    return asked.groupBy("kind", "part").applyInArrow(count, "slice bigint, kind int, part bigint, counts binary, own bigint")


def answers_of(table) -> dict:
    """The answers of one slice by kind, in the order of its sorted distinct keys."""
    found: dict[int, list] = {}
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "part", "counts"))), key=lambda r: r[:2])
    for kind, _, counts in rows:
        found.setdefault(kind, []).append(unpacked(counts))
    return {kind: np.concatenate(x) for kind, x in found.items()}


def answered(slices: DataFrame, answers: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``make(ids, texts, counts by kind)`` of every slice, as Arrow tables of ``schema``."""
    def one(own, told):
        import pyarrow as pa

        if not own.num_rows:
            raise ValueError("answers to a slice that isn't there")
        ids = pa.concat_arrays([c.values for c in own.column("ids").chunks])
        return make(ids, texts(own.column("sizes")[0].as_py(), own.column("blob")[0].as_py()), answers_of(told))

    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(one, schema)
