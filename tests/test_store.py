import json

import pytest
from pyspark.sql import functions as F

from eventide.errors import EventAlreadyExists, EventDeleted, EventNotFound, ReadOnlyTable, TableCorrupted
from eventide.operators import lifecycle, stats
from eventide.plans.filter import EventFilter
from eventide.schema import EVENT_SCHEMA
from eventide.sources import changelog, generate, json_events
from eventide.sources.store import EventTable
from eventide.streaming import ingest

MONTH = 31 * 86400


def row(i, kind=1, author=1, at=None, tags=(), content="x"):
    return (i.to_bytes(32, "big"), author.to_bytes(32, "big"), 1_700_000_000 + i if at is None else at, kind, [list(t) for t in tags], content, b"", False, False)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def ids(rows):
    return [int.from_bytes(r["id"], "big") for r in rows]


@pytest.fixture
def table(spark, tmp_path):
    t = EventTable(spark, f"file://{tmp_path}/events")
    t.append(frame(spark, [row(i, tags=[("t", "Test"), ("e", f"{i % 2}", "relay"), ()], author=i % 2) for i in range(5)]))
    return t


def test_write_query_delete(spark, table):
    assert ids(table.query_all(EventFilter(kinds=(1,)))) == [4, 3, 2, 1, 0]
    assert ids(table.query_all(EventFilter(tags={"t": ("test",), "e": ("0",)}))) == [4, 2, 0]
    assert table.count(EventFilter(kinds=(1,), limit=2)) == 5
    assert ids(table.query_all(EventFilter(authors=((1).to_bytes(32, "big").hex(),)))) == [3, 1]
    table.delete((0).to_bytes(32, "big"))
    assert table.delete_many(frame(spark, [row(2), row(4), row(77)]).select("id")) == 2
    assert ids(table.query_all(EventFilter(limit=10))) == [3, 1] and table.get((2).to_bytes(32, "big")) is None and table.get(row(3)[0])["kind"] == 1
    for missing in (row(2)[0], row(99)[0]):
        with pytest.raises(EventNotFound):
            table.delete(missing)
    with pytest.raises(EventNotFound):
        table.delete_many(frame(spark, [row(99)]).select("id"))


def test_ids_are_stored_once(spark, table):
    table.append(frame(spark, [row(1), row(9), row(9)]))
    assert sorted(ids(table.query_all(EventFilter(limit=100)))) == [0, 1, 2, 3, 4, 9]
    with pytest.raises(EventAlreadyExists):
        table.write(frame(spark, [row(9)]))
    assert table.validate()["healthy"]


def test_compaction_and_recovery(spark, table):
    assert table.compact() == 0
    table.delete_many(frame(spark, [row(0), row(1)]).select("id"))
    table.update_flags(row(2)[0], False, True)
    assert ids(table.query_all(EventFilter(limit=9))) == [4, 3, 2]  # queries show replaced events
    assert table.compact("balanced") == 1
    assert sorted(ids(table.raw.collect())) == [3, 4] and table.flags.isEmpty() and table.validate()["healthy"]
    assert ids(table.query_all(EventFilter(tags={"e": ("0",)}))) == [4]
    table._fs.delete(table._jvm_path(table._folder("tags")), True)
    spark.range(1).write.parquet(f"{table.path}/staged-x")
    assert table.recover() == ["removed staged-x", "rebuilt tags"] and table.validate()["healthy"] and table.recover() == []
    assert table.stats()["live"] == 2 and table.stats()["events_bytes"] > 0
    table.delete_many(frame(spark, [row(3), row(4)]).select("id"))
    assert table.compact("aggressive") == 1 and table.raw.isEmpty() and table.query_all(EventFilter(limit=5)) == []


def test_an_append_moves_what_is_new_once(spark, tmp_path, monkeypatch):
    """The first one writes events and tags alone; later ones write down what comes as well, without a shuffle."""
    from pyspark.sql import DataFrameWriter

    paths, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (paths.append(path), real(self, path, *a, **k))[1])
    t = EventTable(spark, f"{tmp_path}/once")
    t.append(frame(spark, [row(k % 7) for k in range(20)]))
    assert [p.split("/")[-2].rpartition("-")[0] or p.split("/")[-2] for p in paths] == ["events", "tags"]
    t.append(frame(spark, [row(k % 9) for k in range(20)]))
    assert t.raw.count() == 9 and not [n for n in t._names("") if n.startswith("staged")]
    assert t.delete_many(frame(spark, [row(k) for k in (1, 2, 2, 50)]).select("id")) == 2 and not [n for n in t._names("") if n.startswith("staged")]
    with pytest.raises(EventNotFound):
        t.delete_many(frame(spark, [row(1)]).select("id"))
    assert t.visible.count() == 7 and not [n for n in t._names("") if n.startswith("staged")]


def test_empty_tags_are_dropped(spark):
    from eventide.operators.retrieve import drop_empty_tags

    rows = [(0, [["a"], [], ["b", None]]), (1, [["a"], None]), (2, [[], None]), (3, []), (4, None), (5, [[None], ["", ""]])]
    got = {r["id"]: r["tags"] for r in drop_empty_tags(spark.createDataFrame(rows, "id int, tags array<array<string>>")).collect()}
    assert got == {0: [["a"], ["b", None]], 1: [["a"]], 2: [], 3: [], 4: None, 5: [[None], ["", ""]]}


@pytest.mark.parametrize("step", ["_write_events", "_write_tags", "_commit"])
def test_a_batch_that_dies_is_added_whole_when_run_again(spark, table, monkeypatch, step):
    """However far it came, nothing of it is seen; run again, its events and tags are there at once."""
    new = frame(spark, [row(40 + k, tags=[("t", "late")]) for k in range(3)] + [row(1)])
    real = getattr(EventTable, step)

    def die(self, *a):
        if step != "_commit":
            real(self, *a)
        raise RuntimeError("lost")

    monkeypatch.setattr(EventTable, step, die)
    with pytest.raises(RuntimeError):
        table.append(new)
    monkeypatch.undo()
    late = EventFilter(tags={"t": ("late",)})
    assert table.query_all(late) == [] and table.raw.count() == 5 and table.query(late, use_tags=False).count() == 0
    table.append(new)
    assert ids(table.query_all(late)) == [42, 41, 40] == ids(table.query(late, use_tags=False).collect()) and table.raw.count() == 8
    assert any(x.startswith("removed events/batch=") for x in table.recover()) and table.recover() == []
    assert table.raw.count() == 8 and table.validate()["healthy"]


def test_a_stream_batch_that_dies_is_added_whole(spark, tmp_path, monkeypatch):
    src, real, calls = tmp_path / "in", EventTable._write_tags, []
    frame(spark, [row(k, tags=[("t", "x")]) for k in range(6)]).write.parquet(str(src))
    t = EventTable(spark, f"file://{tmp_path}/s")
    run = lambda: ingest.ingest(ingest.read_stream(spark, str(src), wire=False), t, f"{tmp_path}/ck").awaitTermination()

    def die(self, *a):
        calls.append(a)
        raise RuntimeError("lost")

    monkeypatch.setattr(EventTable, "_write_tags", die)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(EventTable, "_write_tags", real)
    run()
    assert calls and t.count(EventFilter(tags={"t": ("x",)})) == 6 == t.raw.count()


def test_compaction_writes_candidates_alone(spark, table):
    table.append(frame(spark, [row(100 + k, at=1_700_000_000 + 3 * MONTH + k, tags=[("t", "far")]) for k in range(4)]))
    table.delete_many(frame(spark, [row(0), row(1), row(2), row(103)]).select("id"))
    later = lambda: {x for x in table.raw.inputFiles() if "period=2024" in x}
    before = later()
    assert before and table.compact("lazy") == 1 and later() == before
    assert sorted(ids(table.raw.collect())) == [3, 4, 100, 101, 102, 103] and sorted(ids(table.flags.collect())) == [103]
    assert ids(table.query_all(EventFilter(limit=9))) == [102, 101, 100, 4, 3] and ids(table.query_all(EventFilter(tags={"t": ("test",)}))) == [4, 3] and table.recover() == []
    table.append(frame(spark, [row(0), row(103, at=1_700_000_000 + 3 * MONTH + 3)]))  # an event that is gone may come back, one that is only flagged is there
    assert ids(table.query_all(EventFilter(limit=9))) == [102, 101, 100, 4, 3, 0] and table.validate()["healthy"]
    table.delete(row(0)[0])
    table.delete(row(3)[0])
    assert table.compact("aggressive") == 2 and ids(table.query_all(EventFilter(limit=9))) == [102, 101, 100, 4] and table.flags.isEmpty() and table.recover() == []


def test_tags_are_changed_over_to(spark, table, monkeypatch):
    """A rebuild that dies leaves the old tags in use."""
    monkeypatch.setattr(EventTable, "_commit", lambda self, state: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.rebuild_tags()
    monkeypatch.undo()
    assert table.count(EventFilter(tags={"t": ("test",)})) == 5
    assert table.recover() == ["removed tags-1"]
    table.rebuild_tags()
    assert table.count(EventFilter(tags={"t": ("test",)})) == 5 and table.validate()["healthy"]


def test_two_writers(spark, table):
    state = table._state()
    table._commit(state)
    with pytest.raises(TableCorrupted):
        table._commit(state)


def test_required_events_and_ranges(spark, table):
    table.delete(row(2)[0])
    assert table.require(row(3)[0])["kind"] == 1
    with pytest.raises(EventDeleted):
        table.require(row(2)[0])
    with pytest.raises(EventNotFound):
        table.require(row(99)[0])
    table.delete_range(1_700_000_000, 1_700_000_003, author=row(0, author=1)[1], kind=1)
    assert ids(table.query_all(EventFilter(limit=9))) == [4, 0]
    table.delete_range(1_700_000_000, 1_700_000_000)
    assert ids(table.query_all(EventFilter(limit=9))) == [4]


def test_periods_are_pruned(spark, table):
    table.append(frame(spark, [row(100 + k, at=1_700_000_000 + k * MONTH) for k in range(3)]))
    f = EventFilter(since=1_700_000_000 + MONTH, until=1_700_000_000 + 2 * MONTH)
    assert ids(table.query_all(f)) == [102, 101]
    assert "PartitionFilters: [isnotnull(period" in table.query(f)._jdf.queryExecution().executedPlan().toString()


def test_replaceable(spark, tmp_path):
    t = EventTable(spark, f"file://{tmp_path}/r")
    d = lambda x: [("d", x)]
    t.replace(frame(spark, [row(1, 0, at=10), row(2, 0, at=20), row(3, 0, 2, at=5), row(4, 30023, at=10, tags=d("a")), row(5, 30023, at=9, tags=d("b")), row(6, 1)]))
    assert sorted(ids(t.latest().collect())) == [2, 3, 4, 5, 6]
    t.replace(frame(spark, [row(7, 30023, at=10, tags=d("a")), row(8, 0, at=20)]))  # ties: the smaller id
    assert sorted(ids(lifecycle.live(t.events).collect())) == [2, 3, 4, 5, 6]


def test_read_only(spark, table):
    t = EventTable(spark, table.path, read_only=True)
    assert len(t.query_all(EventFilter(limit=9))) == 5
    with pytest.raises(ReadOnlyTable):
        t.append(frame(spark, [row(50)]))


def test_empty_table(spark, tmp_path):
    t = EventTable(spark, f"file://{tmp_path}/none")
    assert t.query_all(EventFilter(kinds=(1,))) == [] and t.count(EventFilter(kinds=(1,))) == 0 and t.get(bytes(32)) is None
    assert t.validate()["healthy"] and t.fragmentation().isEmpty()
    assert lifecycle.total_waste(t.fragmentation()).first()["waste_ratio"] == 0.0


def test_json_round_trip(spark, tmp_path):
    one = {"id": "ab" * 32, "pubkey": "CD" * 32, "created_at": 5, "kind": 1, "tags": [["e", "x"], []], "content": "hi", "sig": "ef" * 64}
    (tmp_path / "a.json").write_text(json.dumps([one, one | {"id": "xyz"}, one | {"id": "00" * 32, "kind": 70000}]))
    (tmp_path / "b.json").write_text(json.dumps(one | {"id": "11" * 32}))
    got = json_events.read_json(spark, str(tmp_path)).orderBy("id")
    assert [bytes(r["id"]).hex() for r in got.collect()] == ["11" * 32, "ab" * 32] and got.first()["tags"] == [["e", "x"]]
    json_events.write_json(got, str(tmp_path / "out"))
    assert json_events.read_json(spark, str(tmp_path / "out"), lines=True).orderBy("id").collect() == got.collect()


def test_generators(spark):
    e = generate.cycle_events(spark, 12, authors=3)
    assert e.select("id").distinct().count() == 12 and e.select("pubkey").distinct().count() == 3
    assert [len(r["tags"]) for r in e.orderBy("created_at").collect()] == [0, 0, 0, 1, 0, 2] * 2
    more = generate.expand_seeds(e.where("kind = 1"), 4)
    assert more.count() == 8 and more.select("id").distinct().count() == 8


def test_change_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    i = lambda n: n.to_bytes(32, "big")
    add = lambda rows: changelog.append(spark, path, spark.createDataFrame(rows, "op int, timestamp long, data binary"))
    add([(1, 1, i(1)), (1, 2, i(2)), (4, 3, b"")])
    add([(1, 4, i(3)), (2, 5, i(1) + b"\x01"), (2, 6, i(3) + b"\x02"), (2, 7, i(3) + b"\x01")])
    log = changelog.read(spark, path)
    assert [r["lsn"] for r in log.collect()] == list(range(1, 8)) and changelog.last_checkpoint(log) == 3
    state = {int.from_bytes(r["id"], "big"): (r["inserted"], r["flags"]) for r in changelog.replay(log).collect()}
    assert state == {1: (False, 1), 3: (True, 1)} and changelog.corrupt(log).isEmpty()
    assert changelog.corrupt(log.withColumn("checksum", F.col("checksum") + 1)).count() == 7 and changelog.retained(log, 4).count() == 4
    assert {r["op"]: r["entries"] for r in stats.log_stats(log).collect()} == {"insert": 3, "update_flags": 3, "checkpoint": 1}


def test_stream_into_table(spark, tmp_path):
    src = tmp_path / "in"
    frame(spark, [row(1), row(2), row(2)]).write.parquet(str(src))
    t = EventTable(spark, f"file://{tmp_path}/s")
    run = lambda: ingest.ingest(ingest.read_stream(spark, str(src), wire=False), t, f"{tmp_path}/ck").awaitTermination()
    run()
    frame(spark, [row(2), row(3, at=5)]).write.mode("append").parquet(str(src))
    run()
    run()
    assert ids(t.query_all(EventFilter(limit=9))) == [2, 1, 3]


def test_stream_windows(spark, tmp_path):
    frame(spark, [row(k, at=1_700_000_000 + 100 * k) for k in range(30)]).write.parquet(str(tmp_path / "w"))
    stream = ingest.once_within(ingest.read_stream(spark, str(tmp_path / "w"), wire=False)).drop("at")
    q = ingest.counts_by_window(ingest.read_stream(spark, str(tmp_path / "w"), wire=False), "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == 30
    q = stream.writeStream.format("memory").queryName("o").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM o").first()[0] == 30


def test_sessions_end_when_the_gap_is_over(spark):
    """An event exactly a gap behind the last one is of the next session, as in SQL; a second less and it is of the same."""
    times = {1: [0, 7200, 14399, 14399], 2: [7200, 14401, 21601], 3: [5, 7204, 14403]}
    events = spark.createDataFrame([(p, t) for p, ts in times.items() for t in ts], "pubkey long, created_at long")
    found = sorted((r["pubkey"], r["start"], r["end"], r["n"]) for r in ingest.sessions(events, "2 hours").collect())
    assert found == [(1, 0, 7200, 1), (1, 7200, 21599, 3), (2, 7200, 14400, 1), (2, 14401, 21601, 1), (2, 21601, 28801, 1), (3, 5, 21603, 3)]


def test_metrics():
    m = stats.Metrics()
    m.add("cache_hits", 3)
    m.add("cache_misses")
    m.add("queries", 2)
    m.add("shards_queried", 5)
    for x in range(2000):
        m.observe("query", x)
    m.saw(EventFilter(kinds=(1,), search="x"))
    s = m.snapshot()
    assert s["hit_rate"] == 75.0 and s["shards_per_query"] == 2 and s["query_p50"] == 1500 and m.shapes["kinds+search"] == 1
    assert "eventide_hit_rate 75.0" in m.prometheus()
    m.reset()
    assert m.snapshot()["hit_rate"] == 0.0


def test_sharded_table(spark, tmp_path):
    from eventide.operators.shard import Ring, ShardedTable

    rows = [(k, k % 40, 1000 + k, 1, [], "x", False) for k in range(400)]
    events = spark.createDataFrame(rows, "id long, pubkey long, created_at long, kind int, tags array<array<string>>, content string, deleted boolean")
    t = ShardedTable(spark, f"{tmp_path}/a", Ring(["a", "b", "c"], 60))
    t.append(events)
    f = EventFilter(authors=(3, 5), kinds=(1,), limit=None)
    want = [r[0] for r in rows[::-1] if r[1] in (3, 5)]
    assert [r["id"] for r in t.query(f).collect()] == want and t.count(f) == 20
    assert "PartitionFilters: [shard" in t.query(f)._jdf.queryExecution().executedPlan().toString()
    wider = t.ring.with_shard("d")
    moved = [k for k in range(40) if t.ring.shard_of(str(k)) != wider.shard_of(str(k))]
    assert t.rebalance(wider, f"{tmp_path}/b", dry_run=True) == 10 * len(moved) and t.path.endswith("a")
    assert t.rebalance(wider, f"{tmp_path}/b") == 10 * len(moved) and t.path.endswith("b")
    assert [r["id"] for r in t.query(f).collect()] == want and sum(r["n"] for r in t.distribution().collect()) == 400
    assert all(wider.shard_of(str(r["pubkey"])) == r["shard"] for r in t.events.collect())


def test_ring_column_is_compiled(spark):
    from eventide.operators.shard import Ring

    for ring in (Ring(["a"], 1), Ring(["a", "b", "c"], 1), Ring(["a", "b"], 3000), Ring([f"s{k}" for k in range(7)])):
        df = spark.range(3000).select("id", ring.column(F.col("id").cast("string")).alias("shard"))
        assert all(ring.shard_of(str(r["id"])) == r["shard"] for r in df.collect())
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
        own = ring.lookup(spark.range(300), F.col("id").cast("string")).where("shard <> 'b'")
        assert own._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1  # a condition doesn't repeat it
        assert [(r["id"], r["shard"]) for r in own.collect()] == [(k, ring.shard_of(str(k))) for k in range(300) if ring.shard_of(str(k)) != "b"]


def test_sharded_append_and_rebalance_compare_ids_where_they_must(spark, tmp_path, monkeypatch):
    from eventide.operators.shard import MoveStopped, Ring, ShardedTable

    ring = Ring(["a", "b", "c"], 60)
    events = spark.createDataFrame([(k, k % 40, 1000 + k, "x") for k in range(400)], "id long, pubkey long, created_at long, content string")
    t = ShardedTable(spark, f"{tmp_path}/a", ring)
    t.append(events.where("id < 300"))
    other = next(p for p in range(40) if ring.shard_of(str(p)) != ring.shard_of("0"))
    t.append(events.unionByName(spark.createDataFrame([(0, other, 5, "y")], events.schema)))  # an id that is there comes again with another author
    assert t.events.count() == 400 and t.events.where("id = 0 AND pubkey = 0").count() == 1 and not [n for n in t._names("") if n.startswith("_staged")]
    joins, real = [], type(events).join
    monkeypatch.setattr(type(events), "join", lambda self, other, on=None, how=None: (joins.append(how), real(self, other, on, how))[1])
    t.add_shard("d")
    assert joins == ["left_anti"]  # what is missing in the end; nothing can have been moved before
    seen = []
    with pytest.raises(MoveStopped):
        t.rebalance(t.ring.with_shard("e"), progress=lambda *x: seen.append(x), stop=lambda: len(seen) == 2)
    t.append(events)
    t.add_shard("e")
    assert t.shards() == ["a", "b", "c", "d", "e"] and sorted(r["id"] for r in t.events.collect()) == list(range(400))
    assert all(t.ring.shard_of(str(r["pubkey"])) == r["shard"] for r in t.events.collect())
    assert t.stored.groupBy("id", "shard").count().where("count > 1").isEmpty()


def test_records_are_packed_in_small_pieces():
    """What is held as Python objects follows neither the engine's batches nor the size of rows."""
    import pyarrow as pa

    from eventide.sources import records

    for n, width in ((0, 1), (1, 1), (10_000, 1), (10_000, 4_000), (3, 9_000_000)):
        batch = pa.RecordBatch.from_arrays([pa.array([bytes(width)] * n, pa.binary()), pa.array(range(n), pa.int64())], names=["record", "k"])
        pieces = list(records._pieces(batch))
        assert [k for p in pieces for k in p.column(1).to_pylist()] == list(range(n))
        assert all(p.num_rows == 1 or p.num_rows <= records.MOST_ROWS and p.num_rows * width <= records.MOST_BYTES_AT_ONCE for p in pieces)


def test_records_round_trip_and_damage(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from eventide.sources import records

    event = st.fixed_dictionaries(
        {
            "id": st.binary(min_size=32, max_size=32), "pubkey": st.binary(max_size=32), "created_at": st.integers(0, 2**32 - 1), "kind": st.integers(0, 65535),
            "tags": st.lists(st.lists(st.text(st.characters(codec="utf-8"), max_size=9), max_size=4), max_size=4), "content": st.text(st.characters(codec="utf-8"), max_size=300), "sig": st.binary(max_size=64), "deleted": st.booleans(), "replaced": st.booleans(),
        }
    )

    @settings(max_examples=150, deadline=None)
    @given(event, st.integers(0, 10**6), st.integers(1, 255))
    def check(e, at, change):
        r = records.encode(e)
        assert records.decode(r) == e
        bad = bytearray(r)
        bad[at % len(r)] ^= change
        assert records.decode(bytes(bad)) is None and records.decode(r[: at % len(r)]) is None

    check()
    events = frame(spark, [row(k, tags=[("e", "x" * 5000), ()], content="é" * 9000) for k in range(5)])
    got = records.to_records(events)
    assert sorted(map(tuple, records.from_records(got).collect())) == sorted(map(tuple, events.collect()))
    damaged = got.unionByName(spark.createDataFrame([(b"nonsense",), (b"",), (None,)], "record binary"))
    assert records.scan_records(damaged).where("corrupt").count() == 3 and records.from_records(damaged).count() == 5


def test_shard_verbs_and_rebalancing_in_place(spark, tmp_path):
    from eventide.operators.shard import MoveStopped, Ring, ShardedTable, gather, scatter_gather

    rows = [(k, k % 40, 1000 + k, 1, [], "x", False) for k in range(400)]
    events = spark.createDataFrame(rows, "id long, pubkey long, created_at long, kind int, tags array<array<string>>, content string, deleted boolean")
    t = ShardedTable(spark, f"{tmp_path}/a", Ring(["a", "b", "c"], 60))
    t.append(events.where("id < 300"))
    t.append(events)
    t.append(events)
    assert t.events.count() == 400 and t.shards() == ["a", "b", "c"]
    assert t.get(17)["created_at"] == 1017 and t.get(999) is None
    assert t.delete(spark.createDataFrame([(17,), (18,), (999,)], "id long")) == 2 and t.get(17) is None and t.delete_by_author(3) == 10
    left = {r[0] for r in rows if r[0] not in (17, 18) and r[1] != 3}
    f = EventFilter(kinds=(1,), limit=25)
    assert [r["id"] for r in gather(t.events, f).collect()] == [r["id"] for r in scatter_gather([t.events.where(F.col("shard") == s) for s in t.shards()], f).collect()] == sorted(left)[: -26 : -1]
    wider, seen = t.ring.with_shard("d"), []
    with pytest.raises(MoveStopped):
        t.rebalance(wider, progress=lambda *x: seen.append(x), stop=lambda: len(seen) == 1)
    assert seen == [(1, 3)] and t.shards() == ["a", "b", "c"] and sorted(r["id"] for r in t.events.collect()) == sorted(left)
    files = {x for x in t.stored.inputFiles() if "shard=d" not in x}
    moved = t.add_shard("d")
    assert moved == sum(t.ring.shard_of(str(k % 40)) != Ring(["a", "b", "c"], 60).shard_of(str(k % 40)) for k in left) and files <= set(t.stored.inputFiles())
    again = ShardedTable(spark, t.path, Ring(["a"]))  # the stored ring is used
    assert again.shards() == ["a", "b", "c", "d"] and sorted(r["id"] for r in again.events.collect()) == sorted(left)
    assert [r["id"] for r in again.query(EventFilter(authors=(5,), kinds=(1,), limit=None)).collect()] == sorted((k for k in left if k % 40 == 5), reverse=True)
    again.clean()
    assert again.stored.count() == len(left) and all(again.ring.shard_of(str(r["pubkey"])) == r["shard"] for r in again.stored.collect())
    again.remove_shard("a")
    assert again.shards() == ["b", "c", "d"] and sorted(r["id"] for r in again.events.collect()) == sorted(left)


def test_a_rebalancing_that_misses_events_is_not_used(spark, tmp_path, monkeypatch):
    from eventide.errors import EventideError
    from eventide.operators.shard import Ring, ShardedTable

    events = spark.createDataFrame([(k, k, 1000 + k, 1, [], "x", False) for k in range(60)], "id long, pubkey long, created_at long, kind int, tags array<array<string>>, content string, deleted boolean")
    t = ShardedTable(spark, f"{tmp_path}/a", Ring(["a", "b"], 60))
    t.append(events)
    real = Ring.lookup
    monkeypatch.setattr(Ring, "lookup", lambda self, df, *a: real(self, df.where("id % 2 = 0") if "content" in df.columns else df, *a))
    with pytest.raises(EventideError):
        t.add_shard("c")
    monkeypatch.undo()
    assert t.shards() == ["a", "b"] and t.events.count() == 60
    t.add_shard("c")
    assert sorted(r["id"] for r in t.events.collect()) == list(range(60)) and t.shards() == ["a", "b", "c"]


def test_log_upkeep(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = [(1, k // 3, k.to_bytes(32, "big")) for k in range(500)]
    changelog.append(spark, path, spark.createDataFrame(rows, "op int, timestamp long, data binary").repartition(7))
    log = changelog.read(spark, path)
    assert [(r["lsn"], int.from_bytes(r["data"], "big")) for r in log.collect()] == [(k + 1, k) for k in range(500)]
    assert changelog.checkpoint_due(log, now=0, entries=500) and not changelog.checkpoint_due(log, now=20) and changelog.checkpoint_due(log, now=31)
    assert changelog.checkpoint(spark, path, 200) == 501 and not changelog.checkpoint_due(changelog.read(spark, path), now=10**6)
    changelog.append(spark, path, spark.createDataFrame([(2, 300, b"x")], "op int, timestamp long, data binary"))
    log = changelog.read(spark, path)
    assert tuple(changelog.validate(log).first()) == (502, 0, 0, 0, 0)
    assert tuple(changelog.validate(log.where("lsn <> 7").unionByName(log.where("lsn = 9").withColumn("op", F.lit(99)).withColumn("checksum", F.lit(1).cast("long")))).first()) == (502, 1, 1, 1, 1)
    assert changelog.retain(spark, path, 501) > 0 and [r["lsn"] for r in changelog.read(spark, path).collect()] == [501, 502]
