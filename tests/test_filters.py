import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventide.config import Config
from eventide.errors import InvalidConfig, InvalidFilter
from eventide.functions import scalar
from eventide.operators import retrieve, shard
from eventide.plans import compile as plan
from eventide.plans import filter as filters
from eventide.plans.filter import EventFilter, matches
from eventide.schema import DEFAULT_KINDS

SCHEMA = "id long, pubkey long, created_at long, kind int, tags array<array<string>>, content string, deleted boolean, replaced boolean"
NAMES, VALUES = ["e", "t", "p", "subject"], ["A", "a", "b", "Ä", "ä b", ""]


def event(i, **x):
    return {"id": i, "pubkey": 1, "created_at": 1000, "kind": 1, "tags": [], "content": "test content", "deleted": False, "replaced": False} | x


def found(spark, events, f, **options):
    df = spark.createDataFrame([tuple(e[c] for c in event(0)) for e in events], SCHEMA)
    return [r["id"] for r in retrieve.query(df, f, **options).collect()]


@pytest.mark.parametrize(
    ("f", "hit"),
    [
        (EventFilter(limit=5), True), (EventFilter(kinds=(1,)), True), (EventFilter(kinds=(2, 3)), False), (EventFilter(authors=(1,)), True), (EventFilter(authors=(2,)), False),
        (EventFilter(since=500, until=2000), True), (EventFilter(since=2000), False), (EventFilter(until=1500), True), (EventFilter(until=900), False), (EventFilter(until=1000), True),
        (EventFilter(kinds=(1,), authors=(1,), since=900), True), (EventFilter(search="TEST"), True), (EventFilter(search="nothing"), False),
        (EventFilter(tags={"t": ("HELLO",)}), True), (EventFilter(tags={"t": ("world",)}), False), (EventFilter(search="WORLD"), True), (EventFilter(tags={"e": ("X",)}), False),
        (EventFilter(tags={"e": ("x",), "t": ("hello",)}), True), (EventFilter(tags={"e": ()}), True),
    ],
)
def test_filter_matrix(spark, f, hit):
    e = event(7, tags=[["e", "x"], ["t", "hello", "world"], ["e"], []])
    assert matches(e, f) is hit
    assert found(spark, [e], f) == [7] * hit


events_ = st.lists(
    st.builds(
        lambda i, p, c, k, t, x, d: event(i, pubkey=p, created_at=c, kind=k, tags=t, content=x, deleted=d),
        st.integers(0, 10**6), st.integers(0, 2), st.integers(1, 6), st.sampled_from([0, 1, 3, 7]),
        st.lists(st.lists(st.sampled_from(NAMES + VALUES), max_size=3), max_size=3), st.sampled_from(VALUES), st.booleans(),
    ), max_size=12, unique_by=lambda e: e["id"],
)
filters_ = st.builds(
    lambda k, a, s, u, t, q, n: EventFilter(kinds=k, authors=a, since=min(s, u) if u else s, until=u and max(s, u), tags=t, search=q, limit=n),
    st.lists(st.sampled_from([0, 1, 3, 7]), max_size=2), st.lists(st.integers(0, 2), max_size=2), st.integers(0, 6), st.integers(0, 6),
    st.dictionaries(st.sampled_from(NAMES), st.lists(st.sampled_from(VALUES), max_size=2), max_size=2), st.sampled_from(["", "a", "Ä"]), st.integers(1, 5),
)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(events=events_, f=filters_)
def test_plans_agree_with_plain_python(spark, events, f):
    g = f.normalize()
    want = sorted((e for e in events if not e["deleted"] and matches(e, g)), key=lambda e: (-e["created_at"], e["id"]))
    assert found(spark, events, f) == [e["id"] for e in want][: g.limit]
    df = spark.createDataFrame([tuple(e[c] for c in event(0)) for e in events], SCHEMA)
    assert [r["id"] for r in retrieve.query(df, f, tags=retrieve.explode_tags(df)).collect()] == [e["id"] for e in want][: g.limit]


@pytest.mark.parametrize("f", [EventFilter(), EventFilter(kinds=range(200)), EventFilter(limit=-1), EventFilter(tags={"": ("x",)}), EventFilter(tags={"e": ["x"] * 1001}), EventFilter(since=5, until=4)])
def test_filters_that_make_no_sense(f):
    with pytest.raises(InvalidFilter):
        f.validate()


def test_defaults_are_filled_in_and_the_filter_stays():
    f = EventFilter(authors=(1,))
    assert f.normalize().limit == 100 and f.normalize().kinds == DEFAULT_KINDS and f.limit == 0 and f.kinds == ()
    assert EventFilter(tags={"e": ("x",)}).normalize(7, (1, 6)).kinds == (1, 6)
    assert EventFilter(since=1).normalize().kinds == () and EventFilter(since=1, limit=None).normalize().limit is None


@pytest.mark.parametrize(
    ("f", "path"),
    [(EventFilter(kinds=(1,)), "kind_time"), (EventFilter(kinds=(1,), authors=(1,)), "author_time"), (EventFilter(kinds=(1,), tags={"e": ("x",)}), "search"), (EventFilter(limit=5), "scan"), (EventFilter(kinds=(1,), search="x"), "scan"), (filters.event_by_id(1), "ids")],
)
def test_strategy_and_explain(f, path):
    assert plan.strategy(f.normalize())["strategy"] == path
    assert plan.explain(f.normalize()).startswith(f"Plan: {path}(")


def test_ties_and_paging(spark):
    events = [event(i, created_at=1 + i // 3) for i in range(9)]
    df = spark.createDataFrame([tuple(e[c] for c in event(0)) for e in events], SCHEMA)
    ids, last = [], None
    while True:
        f = EventFilter(kinds=(1,), limit=2)
        page = (retrieve.query(df, f) if last is None else retrieve.page_before(df, f, last["created_at"], last["id"])).collect()
        if not page:
            break
        ids += [r["id"] for r in page]
        last = page[-1]
    assert ids == [6, 7, 8, 3, 4, 5, 0, 1, 2]


def test_long_lists_are_joined(spark):
    events = [event(i, pubkey=i) for i in range(20)]
    assert found(spark, events, EventFilter(authors=range(10, 5000), limit=None)) == list(range(10, 20))
    df = spark.createDataFrame([tuple(e[c] for c in event(0)) for e in events], SCHEMA)
    assert "Join" in retrieve.query(df, EventFilter(authors=range(10, 5000)))._jdf.queryExecution().toString()


def test_predicates_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([tuple(event(i)[c] for c in event(0)) for i in range(5)], SCHEMA)
    df.write.parquet(str(tmp_path / "e"))
    text = retrieve.query(spark.read.parquet(str(tmp_path / "e")), EventFilter(kinds=(1, 6), since=5))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in text and "In(kind" in text and "GreaterThanOrEqual(created_at,5)" in text and "TakeOrderedAndProject" in text


def test_ring_is_the_same_in_python_and_spark(spark):
    ring = shard.Ring(["a", "b", "c"], 50)
    df = spark.range(300).select(F.col("id").cast("string").alias("k"))
    got = {r["k"]: r["shard"] for r in ring.lookup(df, F.col("k")).collect()}
    assert got == {k: ring.shard_of(k) for k in got}
    small = shard.Ring(["a", "b"], 3)
    assert {r["k"]: r["s"] for r in df.select("k", small.column(F.col("k")).alias("s")).collect()} == {k: small.shard_of(k) for k in got}
    assert shard.Ring.hash("x") == int.from_bytes(hashlib.sha256(b"x").digest()[:4], "big")


@pytest.mark.parametrize(("shards", "nodes", "most"), [(2, 150, 0.2), (4, 150, 0.2), (8, 300, 0.18)])
def test_ring_balance(shards, nodes, most):
    ring = shard.Ring([f"s{i}" for i in range(shards)], nodes)
    counts = {s: 0 for s in ring.shards}
    for i in range(10_000):
        counts[ring.shard_of(f"key-{i}")] += 1
    assert max(abs(n - 10_000 / shards) for n in counts.values()) <= most * 10_000 / shards


def test_functions(spark):
    df = spark.createDataFrame([(1735516800, [["d", "x"], ["d", "y"], ["e"]]), (4294967295, [])], "t long, tags array<array<string>>")
    got = df.select(scalar.period(F.col("t"), "weekly").alias("w"), scalar.period(F.col("t")).alias("m"), scalar.first_tag(F.col("tags"), "d").alias("d"), scalar.replacement_d(F.col("tags")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("2025-W01", "2024-12", "x", "x"), ("2106-W05", "2106-02", None, "")]
    key = df.select(scalar.index_key(F.lit(bytes(32)), F.lit(7), F.col("t")).alias("k")).select("k", scalar.key_timestamp(F.col("k")).alias("t")).collect()
    assert [r["t"] for r in key] == [1735516800, 4294967295] and len(key[0]["k"]) == 38
    bad = spark.createDataFrame([("AB" * 32,), ("zz" * 32,), ("ab",), (None,)], "h string").select(scalar.from_hex(F.col("h")).alias("b")).collect()
    assert [None if r["b"] is None else bytes(r["b"]).hex() for r in bad] == ["ab" * 32, None, None, None]


def test_config(tmp_path):
    c = Config.from_dict({"shard": {"count": 8}, "query": {"default_kinds": [1, 6]}})
    c.save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json"), {}) == c and c.query.default_kinds == (1, 6)
    assert Config.load(str(tmp_path / "c.json"), {"EVENTIDE_SHARD_COUNT": "3", "EVENTIDE_LOG_ENABLED": "true", "EVENTIDE_QUERY_DEFAULT_KINDS": "4,5"}).query.default_kinds == (4, 5)
    for bad in ({"shard": {"counts": 1}}, {"nope": {}}, {"index": {"granularity": "daily"}}, {"storage": {"write_batch_size": 20000}}):
        with pytest.raises(InvalidConfig):
            Config.from_dict(bad)
    with pytest.raises(InvalidConfig):
        c.with_environment({"EVENTIDE_SHARD_COUNT": "many"})
