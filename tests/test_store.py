import pytest

from logstrata import store
from logstrata.operators import bloom, lww
from logstrata.sources import runfile
from logstrata.sources.tables import LOG_SCHEMA
from logstrata.store import Store
from logstrata.streaming import ingest


def held(df):
    return {r.key: r.value for r in df.collect()}


def test_add_delete_get_reopen(spark, tmp_path):
    with Store(spark, str(tmp_path)) as s:
        assert s.add("a", "1") and s.add("", "") and s.delete("z") and s.add("b", "x")
        s.flush()
        assert s.delete("b") and s.add("a", "2")
        assert [s.get(k) for k in ("a", "", "z", "b", "none")] == ["2", "", None, None, None]
    assert not s.valid and not s.add("q", "1") and s.get("a") is None
    again = Store(spark, str(tmp_path))
    assert held(again.snapshot()) == {"a": "2", "": ""}
    probes = spark.createDataFrame([("a",), ("b",), ("none",)], "key string")
    assert {r.key: r.status for r in again.multi_get(probes).collect()} == {"a": "FOUND", "b": "DELETED", "none": "NOT_FOUND"}
    assert again.add("b", "back") and again.get("b") == "back"


def test_compaction_keeps_the_state(spark, tmp_path):
    s, model = Store(spark, str(tmp_path), buffer_bytes=40, run_bytes=200), {}
    for i in range(28):
        key = f"k{i % 5}"
        if i % 7 == 3:
            s.delete(key), model.pop(key, None)
        else:
            s.add(key, str(i))
            model[key] = str(i)
        s.flush()
    assert s.levels[0] <= 8 and len(s.levels) > 1
    with s.pinned() as old:
        held_files = {r["name"] for r in s._state["runs"]}
        for i in range(9):
            s.add("z", str(i))
            s.flush()
        model["z"] = "8"
        assert s.collect_garbage() >= 8 and held_files - {r["name"] for r in s._state["runs"]}
        assert held(lww.snapshot(old)) == {k: v for k, v in model.items() if k != "z"}
    assert s.collect_garbage() > 0
    s.close()
    assert held(Store(spark, str(tmp_path)).snapshot()) == model


def test_runs_are_cut_and_levels_have_caps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LEVEL_CAPS", (8, 16))
    s = Store(spark, str(tmp_path), run_bytes=300)
    rows = [(i, 0, f"k{i:03d}", "v" * 20) for i in range(60)]
    for part in range(8):
        s.write(spark.createDataFrame(rows[part::8], LOG_SCHEMA))
    assert s.levels == [8]
    s.add("last", "1")
    s.flush()
    assert s.levels[0] == 1 and 4 <= s.levels[1] <= 12
    files = [r["name"] for r in s._state["runs"] if r["level"] == 1]
    bounds = sorted(tuple(spark.read.parquet(f"{tmp_path}/{f}").selectExpr("min(key)", "max(key)").first()) for f in files)
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    with pytest.raises(RuntimeError, match="full"):
        for i in range(40):
            s.add("more", str(i))
            s.flush()
    assert s.valid and s.get("more") == str(i) and len(held(s.snapshot())) == 62


def test_a_failed_publish_loses_nothing(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    batch = spark.createDataFrame([(0, 0, "a", "1")], LOG_SCHEMA)
    save = store.Manifest.save
    monkeypatch.setattr(store.Manifest, "save", lambda *_: (_ for _ in ()).throw(OSError("disk")))
    s.add("b", "2")
    for attempt in (s.flush, lambda: s.write(batch, ("w", 0))):
        with pytest.raises(OSError):
            attempt()
    monkeypatch.setattr(store.Manifest, "save", save)
    assert s.write(batch, ("w", 0)) and s.write(batch, ("w", 0))
    assert held(s.snapshot()) == held(Store(spark, str(tmp_path)).snapshot()) == {"a": "1", "b": "2"}
    assert s.levels == [2] and s.collect_garbage() >= 1  # runs of the failed writes


def test_a_killed_writer_s_mutations_come_back(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.add("a", "1"), s.add("b", "2")
    s.flush()
    s.delete("a"), s.add("c", "é"), s.add("b", "3")
    log = tmp_path / "log" / "1.log"
    log.write_bytes(log.read_bytes() + runfile.record(0, b"torn", b"value")[:-3])  # the crash cuts the last record
    again = Store(spark, str(tmp_path))
    assert held(again.snapshot()) == {"b": "3", "c": "é"} and again.get("a") is None and again.get("torn") is None
    again.add("d", "4")  # a second crash
    third = Store(spark, str(tmp_path))
    assert held(third.snapshot()) == {"b": "3", "c": "é", "d": "4"}
    third.close()
    assert not list((tmp_path / "log").glob("*.log"))
    assert held(Store(spark, str(tmp_path)).snapshot()) == {"b": "3", "c": "é", "d": "4"}


def test_filter_is_stored_and_made_again(spark, tmp_path):
    s = Store(spark, str(tmp_path), filter_keys=500)
    s.write(spark.range(300).selectExpr("id as seq", "cast(0 as tinyint) as op", "concat('k', id) as key", "'v' as value"))
    s.add("own", "1")
    assert all(s.may_hold(f"k{i}") for i in range(300)) and s.may_hold("own")
    assert sum(s.may_hold(f"absent{i}") for i in range(1000)) < 60
    before = bytes(s._filter)
    s.close()
    again = Store(spark, str(tmp_path), filter_keys=500)
    assert again._state["filter"] and bytes(again._filter) == before
    again.delete("gone")
    crashed = Store(spark, str(tmp_path), filter_keys=500)
    assert crashed.may_hold("gone") and bytes(crashed._filter) == bytes(again._filter)
    other = Store(spark, str(tmp_path), filter_keys=100)  # of another size: built from the runs
    assert all(other.may_hold(f"k{i}") for i in range(300)) and other.get("k7") == "v" and other.get("nothing") is None
    bits = spark.createDataFrame([(k,) for k in ("a", "b", "é", "")], "key string")
    made = bloom.build(bits, 70_000)
    assert {r.key for r in bloom.probe_stored(made, bits, 70_000).collect() if r.may_exist} == {"a", "b", "é", ""}
    assert sorted(p for k in ("a", "b", "é", "") for p in bloom.positions_of(k, 70_000)) == sorted(r.pos for r in bloom.exploded(bits, 70_000).collect())


def test_second_writer_fails(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.add("a", "1"), two.add("a", "2")
    one.close()
    with pytest.raises(RuntimeError):
        two.flush()
    assert held(Store(spark, str(tmp_path)).snapshot()) == {"a": "1"} and not two.valid


def test_stream_is_ingested_once(spark, tmp_path):
    log = [(0, 0, "a", "1"), (1, 0, "b", "2"), (2, 1, "a", None)]
    spark.createDataFrame(log, "seq bigint, op tinyint, key string, value string").coalesce(1).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for checkpoint in ("c1", "c2"):  # a lost checkpoint replays the same batch
        ingest.ingest(ingest.log_stream(spark, str(tmp_path / "in")), store, "w", str(tmp_path / checkpoint)).awaitTermination()
    assert held(store.snapshot()) == {"b": "2"} and store.levels == [1]
    q = ingest.live_state(ingest.log_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.key, r.op) for r in spark.table("live").collect()} == {("a", 1), ("b", 0)}


def test_run_files_round_trip(spark, tmp_path):
    rows = [(0, 0, "10", "é\x00"), (0, 0, "9", ""), (0, 1, "a", None), (1, 0, "", "x" * 100), (1, 0, "z", "y")]
    df = spark.createDataFrame(rows, "run_id int, op tinyint, key string, value string")
    for r in runfile.encode(df, block_bytes=60).collect():
        (tmp_path / f"{r.run_id}.sst").write_bytes(r.content)
        index = runfile.index_of(bytes(r.content))
        assert len(index) == (1, 2)[r.run_id] and index[0][2] == 0
        assert index[-1][1] == max(k for n, _, k, _ in rows if n == r.run_id).encode()
    found = [(int(r.path[-5]), r.op, r.key, r.value) for r in runfile.read_runs(spark, str(tmp_path)).orderBy("path", "place").collect()]
    assert found == rows
    with pytest.raises(ValueError):
        runfile.index_of(b"\0" * 40)
    run = runfile.encoded([(0, b"%03d" % i, b"v" * i) for i in range(0, 100, 2)] + [(1, b"zz", None)], block_bytes=200)
    assert [runfile.get(run, k) for k in (b"000", b"098", b"zz", b"001", b"~", b"")] == [(0, b""), (0, b"v" * 98), (1, None), None, None, None]
    data = runfile.record(0, b"k", b"v1") + runfile.record(1, b"k", None)
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "0.log").write_bytes(data)
    replayed = runfile.read_log(spark, str(tmp_path / "log")).withColumnRenamed("place", "seq")
    assert lww.snapshot(replayed).count() == 0 and replayed.count() == 2
    with pytest.raises(ValueError):
        list(runfile.records(data[:-3]))
