"""Queries that answer for the whole log, against brute force in Python."""

import time
from collections import OrderedDict

from logstrata.operators import blocks, compact, lru
from logstrata.plans import catalogue
from logstrata.plans.catalogue import CATALOGUE
from logstrata.sources.tables import events_log

D = "/root/testdata/sf0.01"


def test_lru_replays_every_access(spark):
    cache, want = OrderedDict(), []
    for r in events_log(spark, D).orderBy("seq").collect():
        want.append((r.seq, r.key, r.key in cache))
        cache[r.key] = None
        cache.move_to_end(r.key)
        if len(cache) > catalogue.CAPACITY:
            cache.popitem(last=False)
    got = [tuple(r) for r in CATALOGUE["kv_lru_hits"][0](spark, D).orderBy("seq").collect()]
    assert got == want


def test_every_run_is_probed_and_every_group_compacted(spark):
    log = events_log(spark, D).orderBy("seq").collect()
    runs, groups = {}, {}
    for r in log:
        runs.setdefault(r.seq // catalogue.PER_RUN, {})[r.key] = r
    for i, held in runs.items():
        groups.setdefault(i // 8, []).append(held)
    status = {None: "NOT_FOUND", 0: "FOUND", 1: "DELETED"}
    found = CATALOGUE["kv_block_lookup"][0](spark, D).collect()
    assert {r.run_id for r in found} == set(runs) and len(found) == len(runs) * len({r.key for r in found})
    for r in found:
        mine = runs[r.run_id].get(r.key)
        assert (r.status, r.value) == (status[mine and mine.op], mine and mine.value)
    merged = {g: {k: r for held in members for k, r in held.items()} for g, members in groups.items()}
    rows = [tuple(r) for r in CATALOGUE["kv_compact_eight"][0](spark, D).collect()]
    assert sorted(rows) == sorted((g, k, r.op, r.value, r.seq) for g, keys in merged.items() for k, r in keys.items())
    stats = {r.group_id: tuple(r)[1:] for r in CATALOGUE["kv_compaction_stats"][0](spark, D).collect()}
    for g, members in groups.items():
        read, made = sum(map(len, members)), len(merged[g])
        assert stats[g] == (read, made, read - made, sum(r.op for r in merged[g].values()))


def test_lru_blocks_that_are_smaller_than_the_cache_s_reach(spark):
    """Gaps in the sequence, keys not seen for many blocks, and a hot key, against a cache in Python."""
    keys = [("hot" if i % 3 else f"k{i * 7919 % 97}") for i in range(3000)]
    rows = [(3 * i + (i > 1500) * 900, k) for i, k in enumerate(keys)]
    for capacity in (1, 5, 60):
        cache, want = OrderedDict(), []
        for seq, key in rows:
            want.append((seq, key, key in cache))
            cache[key] = None
            cache.move_to_end(key)
            if len(cache) > capacity:
                cache.popitem(last=False)
        got = lru.hits(spark.createDataFrame(rows, "seq bigint, key string"), capacity, block=300).orderBy("seq").collect()
        assert [tuple(r) for r in got] == want
    assert lru.hits(spark.createDataFrame([], "seq bigint, key string"), 5).count() == 0


def test_layout_of_long_runs_is_linear(spark):
    rows = spark.range(40_000).selectExpr("id % 2 as run_id", "lpad(id, 8, '0') as key", "cast(0 as tinyint) as op", "repeat('x', cast(id % 50 as int)) as value")
    began = time.time()
    placed = blocks.layout(rows, 4096).collect()
    assert time.time() - began < 20
    for run in (0, 1):
        held = block = offset = 0
        for r in sorted((r for r in placed if r.run_id == run), key=lambda r: r.key):
            assert (r.block_no, r.offset) == (block, offset)
            held, offset = held + r.size, offset + r.size
            if held >= 4096:
                block, held = block + 1, 0


def test_levels_end_with_their_caps():
    full = compact.simulate(10**9)
    assert full.files == list(compact.LEVEL_CAPS) and compact.simulate(96).files[:3] == [8, 80, 8]
