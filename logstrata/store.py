"""A key-value store over Spark tables: open, add, delete, get, flush, compact, close.

Mutations are numbered in the order they are made. Single ones go to a log file
first and then to a bounded buffer; a full buffer, or a batch given as a
DataFrame, becomes a sorted Parquet run in level 0. Opening a store replays the
logs that no run holds yet, up to a record that a crash has cut.

Levels hold runs up to their caps. When level 0 is full, the first level with
room for FAN_IN runs is sought, and from there up the FAN_IN oldest runs of each
level are merged into the next, as one aggregate whose result is cut at
``run_bytes``. If every level is full a flush fails, and nothing is lost.

The manifest is a small JSON file a version. A new state is published first and
taken on then: a write that fails leaves the store as it was, so it can be tried
again. A version is created once, so of two writers one fails instead of losing
the other's runs. Runs that no manifest names are found by listing.

A lookup asks the Bloom filter, a cache of rows and the buffer, then the runs
with its key pushed down to their bounds and own filters. Tombstones stay until
a merge has nothing below it. Keys are strings and never null; a value is null
only when deleted.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.exprs import FOOTER_BYTES, INDEX_OVERHEAD, RECORD_OVERHEAD, record_bytes
from logstrata.operators import bloom, lookup, lww, runs
from logstrata.operators.compact import FAN_IN, LEVEL_CAPS, merge
from logstrata.sources import runfile
from logstrata.sources.tables import LOG_SCHEMA

BUFFER_BYTES = RUN_BYTES = 2 << 20
BLOCK_BYTES = 65_536  # of the buffer's estimate
BITS_PER_KEY = 10
KEPT_VERSIONS = 2
COLUMNS = ("seq", "op", "key", "value")


class Files:
    """A store's folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        # A local file system with checksums holds back what doesn't fill one; a log must not.
        self._logs = jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration()).getRawFileSystem() if self._fs.getUri().getScheme() == "file" else self._fs
        self._io = jvm.org.apache.commons.io.IOUtils
        self.root = root

    def path(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str, raw: bool = False) -> bytes:
        stream = (self._logs if raw else self._fs).open(self.path(name))
        try:
            return bytes(self._io.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        stream = self._fs.create(self.path(name))
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def put_new(self, name: str, data: bytes) -> bool:
        """Written beside and renamed, so the file is whole or absent; False where it is there already.

        Between two that race, the file system's rename decides: it must not replace a file, as HDFS's doesn't.
        """
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.{uuid.uuid4().hex}"
        self.write(draft, data)
        if self._fs.exists(self.path(name)) or not self._fs.rename(self.path(draft), self.path(name)):
            self._fs.delete(self.path(draft), False)
            return False
        return True

    def appender(self, name: str):
        return self._logs.create(self.path(name), True)

    def remove(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


class Manifest:
    """Versions of a store's list of runs."""

    def __init__(self, files: Files):
        self._files = files

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._files.names("manifest") if n.endswith(".json") and n[0] != ".")

    def load(self) -> tuple[int, dict]:
        found = self.versions()
        if not found:
            return 0, {"next_seq": 0, "runs": [], "batches": {}, "log": 0, "filter": None}
        return found[-1], json.loads(self._files.read(f"manifest/{found[-1]}.json"))

    def save(self, version: int, state: dict) -> None:
        if not self._files.put_new(f"manifest/{version}.json", json.dumps(state).encode()):
            raise RuntimeError(f"another writer has made version {version} of {self._files.root}")


class Store:
    """``filter_keys`` is the number of keys that the Bloom filter is made for, 0 for none; ``cached_rows`` bounds the cache of rows."""

    def __init__(self, spark: SparkSession, path: str, buffer_bytes: int = BUFFER_BYTES, run_bytes: int = RUN_BYTES, filter_keys: int = 100_000, cached_rows: int = 10_000):
        self.spark, self.path, self.buffer_bytes, self.run_bytes, self.cached_rows = spark, path, buffer_bytes, run_bytes, cached_rows
        self._files = Files(spark, path)
        self._manifest = Manifest(self._files)
        self._version, self._state = self._manifest.load()
        self._buffer: dict[str, tuple[int, int, str | None]] = {}
        self._estimate, self._block = FOOTER_BYTES, 0
        self._rows: OrderedDict[str, str | None] = OrderedDict()
        self._pins: dict[str, int] = {}
        self._open, self._log = True, None
        self._bits = filter_keys * BITS_PER_KEY
        self._filter = self._load_filter() if filter_keys else None
        self._next = self._state["next_seq"]
        self._recover()

    @property
    def valid(self) -> bool:
        return self._open

    @property
    def levels(self) -> list[int]:
        """Runs by level."""
        held = [r["level"] for r in self._state["runs"]]
        return [held.count(i) for i in range(max(held, default=-1) + 1)]

    @property
    def estimate(self) -> int:
        """Bytes that the buffer would take as a run, counted by whole blocks of first mutations."""
        return self._estimate

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def add(self, key: str, value: str) -> bool:
        if value is None:
            raise ValueError("a value is a string")
        return self._put(key, 0, value)

    def delete(self, key: str) -> bool:
        """A tombstone, for an absent key too."""
        return self._put(key, 1, None)

    def _put(self, key, op, value) -> bool:
        if key is None:
            raise ValueError("a key is a string")
        if not self._open:
            return False
        if self._estimate >= self.buffer_bytes:
            self.flush()
        if self._log is None:
            self._log = self._files.appender(f"log/{self._log_number}.log")
        self._log.write(bytearray(runfile.record(op, key.encode(), None if value is None else value.encode())))
        self._log.hflush()
        self._apply(key, op, value)
        self._remember(key, value)
        return True

    def _apply(self, key, op, value) -> None:
        if key not in self._buffer:
            self._block += RECORD_OVERHEAD + len(key.encode()) + len((value or "").encode())
            if self._block >= min(BLOCK_BYTES, self.buffer_bytes):
                self._estimate += self._block + INDEX_OVERHEAD + len(key.encode())
                self._block = 0
        self._buffer[key] = (self._next, op, value)
        self._next += 1
        if self._filter is not None:
            for p in bloom.positions_of(key, self._bits):
                self._filter[p >> 3] |= 1 << (p & 7)

    def _remember(self, key, value) -> None:
        self._rows[key] = value
        self._rows.move_to_end(key)
        if len(self._rows) > self.cached_rows:
            self._rows.popitem(last=False)

    def get(self, key: str) -> str | None:
        """The value; None if the key is deleted or absent, or the store closed."""
        if not self._open or not self.may_hold(key):
            return None
        if key in self._rows:
            self._rows.move_to_end(key)
            return self._rows[key]
        if key in self._buffer:
            return self._buffer[key][2]
        newest = lww.latest(self._published().filter(F.col("key") == key)).first()
        if newest is None or newest.op:
            return None
        self._remember(key, newest.value)
        return newest.value

    def may_hold(self, key: str) -> bool:
        """False only if no mutation has named the key."""
        return self._filter is None or all(self._filter[p >> 3] >> (p & 7) & 1 for p in bloom.positions_of(key, self._bits))

    def log(self) -> DataFrame:
        """Every mutation that still counts: published runs and the buffer."""
        rows = [(seq, op, key, value) for key, (seq, op, value) in self._buffer.items()]
        return self._published().unionByName(self.spark.createDataFrame(rows, LOG_SCHEMA)) if rows else self._published()

    def snapshot(self) -> DataFrame:
        return lww.snapshot(self.log())

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return lookup.multi_get(self.log(), probes)

    @contextmanager
    def pinned(self) -> Iterator[DataFrame]:
        """log() whose runs stay until the block ends, whatever is merged or collected meanwhile."""
        names = [r["name"] for r in self._state["runs"]]
        for n in names:
            self._pins[n] = self._pins.get(n, 0) + 1
        try:
            yield self.log()
        finally:
            for n in names:
                self._pins[n] -= 1
                if not self._pins[n]:
                    del self._pins[n]

    def write(self, mutations: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """A batch (seq, op, key, value) after all before it, as one run; its own ``seq``, from 0 on, orders it.

        A ``batch`` (a writer's name, a number that grows) that has been written before is left out.
        """
        if not self._open:
            return False
        if batch and self._state["batches"].get(batch[0], -1) >= batch[1]:
            return True
        self.flush()
        state = self._with_room()
        newest = lww.latest(mutations.filter("key is not null")).withColumn("seq", F.col("seq") + self._next)
        name = self._save(newest, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        top = self._read([name]).agg(F.max("seq")).first()[0]
        if batch:
            state["batches"][batch[0]] = batch[1]
        if top is not None:
            state["next_seq"] = top + 1
            state["runs"].append({"level": 0, "name": name})
        self._publish(state)
        self._next = state["next_seq"]
        if top is not None:
            self._rows.clear()
            if self._filter is not None:
                self._insert(bloom.build(self._read([name]).select("key"), self._bits))
        return True

    def flush(self) -> None:
        if not self._buffer:
            return
        state = self._with_room()
        rows = [(seq, op, key, value) for key, (seq, op, value) in self._buffer.items()]
        state["runs"].append({"level": 0, "name": self._save(self.spark.createDataFrame(rows, LOG_SCHEMA), 1)})
        state |= {"next_seq": self._next, "log": self._log_number + 1}
        self._publish(state)
        self._buffer, self._estimate, self._block = {}, FOOTER_BYTES, 0
        self._end_log()

    def close(self) -> None:
        """The buffer becomes a run and the filter a file."""
        if self._open:
            self.flush()
            if self._filter is not None and self._state["filter"] != [self._version, self._bits]:
                state = copy.deepcopy(self._state) | {"filter": [self._version + 1, self._bits]}
                self._files.write(f"filter/{self._version + 1}", bytes(self._filter))
                self._publish(state)
            self._open = False

    def collect_garbage(self) -> int:
        """Deletes runs that the manifest doesn't name and nothing pins, those of writes that failed too, old versions and old filters.

        Returns the number of runs. Plans made before a merge still read its inputs: pin them, or call this when they have ended.
        """
        named = {r["name"].split("/")[1] for r in self._state["runs"]} | {n.split("/")[1] for n in self._pins}
        gone = [n for n in self._files.names("runs") if n not in named]
        for n in gone:
            self._files.remove(f"runs/{n}")
        for v in self._manifest.versions()[:-KEPT_VERSIONS]:
            self._files.remove(f"manifest/{v}.json")
        for n in self._files.names("filter"):
            if self._state["filter"] and int(n) < self._state["filter"][0]:
                self._files.remove(f"filter/{n}")
        for n in self._logs():
            if n < self._state["log"]:
                self._files.remove(f"log/{n}.log")
        return len(gone)

    def _logs(self) -> list[int]:
        return sorted(int(n[:-4]) for n in self._files.names("log") if n.endswith(".log"))

    def _recover(self) -> None:
        """Replays the logs that no run holds, in their order. They stay until their mutations are in a run."""
        live = [n for n in self._logs() if n >= self._state["log"]]
        self._log_number = max(live, default=self._state["log"] - 1) + 1
        for n in live:
            data = self._files.read(f"log/{n}.log", raw=True)
            for op, key, value in runfile.records(data, cut=True):
                self._apply(key.decode(), op, None if value is None else value.decode())

    def _end_log(self) -> None:
        if self._log is not None:
            self._log.close()
            self._log = None
        for n in self._logs():
            if n < self._state["log"]:
                self._files.remove(f"log/{n}.log")
        self._log_number = self._state["log"]

    def _load_filter(self) -> bytearray:
        """The stored filter if it is of this version and size, else one built from the runs' keys."""
        if self._state["filter"] == [self._version, self._bits]:
            return bytearray(self._files.read(f"filter/{self._version}"))
        self._filter = bytearray(-(-self._bits // 8))
        if self._state["runs"]:
            self._insert(bloom.build(self._published().select("key").distinct(), self._bits))
        return self._filter

    def _insert(self, bitmaps: DataFrame) -> None:
        """Bitmaps of this filter's size: a number of rows that the data doesn't change."""
        for row in bitmaps.toLocalIterator():
            at = row.bucket * bloom.BUCKET_BITS // 8
            held = self._filter[at : at + len(row.bits)]
            self._filter[at : at + len(held)] = bytes(a | b for a, b in zip(held, row.bits))

    def _with_room(self) -> dict:
        """A copy of the state; where level 0 is full, one that merges have made and that is published."""
        runs_of = lambda state, level: [r for r in state["runs"] if r["level"] == level]
        state = copy.deepcopy(self._state)
        if len(runs_of(state, 0)) < LEVEL_CAPS[0]:
            return state
        target = next((i for i in range(1, len(LEVEL_CAPS)) if len(runs_of(state, i)) + FAN_IN <= LEVEL_CAPS[i]), None)
        if target is None:
            raise RuntimeError(f"every level of {self.path} is full")
        for level in range(target, 0, -1):
            oldest = runs_of(state, level - 1)[:FAN_IN]
            rest = [r for r in state["runs"] if r not in oldest]
            merged = merge(self._read([r["name"] for r in oldest]))
            if not any(r["level"] >= level for r in rest):
                merged = merged.filter("op = 0")
            state["runs"] = rest + [{"level": level, "name": n} for n in self._save_cut(merged)]
        self._publish(state)
        return copy.deepcopy(self._state)

    def _publish(self, state: dict) -> None:
        """``state`` becomes the store's once its manifest is there."""
        try:
            self._manifest.save(self._version + 1, state)
        except RuntimeError:
            self._open = False  # another writer's runs are not in this state
            raise
        self._version, self._state = self._version + 1, state

    def _save(self, rows: DataFrame, parts: int) -> str:
        name = f"runs/{uuid.uuid4().hex}"
        runs.write_sorted(rows.select(*COLUMNS), f"{self.path}/{name}", parts)
        return name

    def _save_cut(self, rows: DataFrame) -> list[str]:
        """Runs of about ``run_bytes`` each, one a file, that share no key."""
        size = rows.agg(F.coalesce(F.sum(record_bytes(F.col("key"), F.col("value"))), F.lit(0))).first()[0]
        folder = self._save(rows, max(1, -(-size // self.run_bytes)))
        return [f"{folder}/{n}" for n in sorted(self._files.names(folder)) if n.endswith(".parquet")]

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(*[f"{self.path}/{n}" for n in names])

    def _published(self) -> DataFrame:
        return self._read([r["name"] for r in self._state["runs"]])
