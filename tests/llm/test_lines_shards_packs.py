import heapq
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import line_dedup, packing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_lines(rows, ratio, least):
    pages, have = Counter(), defaultdict(Counter)
    for _, text, _, host, _ in rows:
        if host is not None:
            pages[host] += 1
            for x in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
                have[host][x] += 1
    out = []
    for i, text, lang, host, n in rows:
        if text is not None and host is not None:
            kept = [x for x in text.split("\n") if not (have[host][x.strip(" ")] >= least and have[host][x.strip(" ")] / pages[host] > ratio)]

            text, n = "\n".join(kept), len("\n".join(kept)) if any(have[host][x] >= least and have[host][x] / pages[host] > ratio for x in have[host]) else n
        out.append((i, text, lang, host, n))
    return out


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_line_dedup_brute_force(spark, broadcast):
    rng = random.Random(1)
    lines = [f"line {k}" for k in range(30)] + [" menu", "menu ", "", "foot"]
    rows = [(k, "\n".join(rng.choices(lines, weights=[1] * 30 + [8, 8, 4, 6], k=rng.randint(1, 9))), "en", rng.choice(["a", "b", None]), 5) for k in range(120)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS), 0.3, 5, broadcast_lines=broadcast)
    assert sorted(map(tuple, got.collect())) == sorted(brute_lines(rows, 0.3, 5))


def test_line_dedup_odd(spark, odd_docs, odd_rows, no_docs):
    got = line_dedup.line_dedup(odd_docs, 0.3, 2, n_dropped="dropped_lines")
    assert got.columns == [*odd_docs.columns, "dropped_lines"] and got.count() == len(odd_rows)
    want = sorted((r[:4] for r in brute_lines(odd_rows, 0.3, 2)), key=repr)
    assert sorted((tuple(r[:4]) for r in got.collect()), key=repr) == want
    assert {r["text"] for r in got.where("doc_id = 2").collect()} == {""}
    assert line_dedup.line_dedup(no_docs).collect() == []


def lpt(groups, shards):
    heap, out = [(0, s) for s in range(shards)], {}
    for key, size in groups:
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_lpt_runs_equal_a_heap_by_groups(seed):
    rng = random.Random(seed)
    shards = rng.randint(1, 6)
    sizes = Counter(rng.choice([1, 1, 2, 3, 7, 7, 50]) for _ in range(rng.randint(0, 60)))
    runs, loads = sharding.lpt_runs(list(sizes.items()), shards)
    want = lpt([((s, k), s) for s in sorted(sizes, reverse=True) for k in range(sizes[s])], shards)
    got = {}
    for s, n in sizes.items():
        head, cycle = runs[s]
        for k in range(n):
            got[(s, k)] = head[k] if k < len(head) else cycle[(k - len(head)) % len(cycle)]
    assert got == want
    total = [0] * shards
    for (s, _), x in want.items():
        total[x] += s
    assert loads == total


@pytest.mark.parametrize("seed", range(60))
def test_stretches_equal_a_heap_by_groups(seed):
    """Few large groups before many small ones, so that it takes long to get level; by arrays as tasks look them up."""
    rng = random.Random(seed)
    shards = rng.randint(1, 9)
    sizes = Counter(rng.choice([1, 2, 3, 5, 40, 41, 300, 1000]) for _ in range(rng.randint(1, 12))) + Counter({rng.choice([1, 2, 3]): rng.randint(0, 900), 7: rng.randint(0, 200)})
    runs, loads = sharding.lpt_runs(list(sizes.items()), shards)
    want = lpt([((s, k), s) for s in sorted(sizes, reverse=True) for k in range(sizes[s])], shards)
    total = [0] * shards
    for (s, _), x in want.items():
        total[x] += s
    assert loads == total
    keys = list(want)
    assert sharding.Places(runs).of(np.array([s for s, _ in keys]), np.array([k for _, k in keys])).tolist() == [want[k] for k in keys]


def test_a_giant_group_takes_memory_by_shards():
    runs, _ = sharding.lpt_runs([(10**9, 1), (10, 10**6), (0, 5)], 64)
    head, cycle = runs[10]
    assert len(head) == 10**6 and len(head.stretches) <= 64 and sum(len(c) for _, c in head.stretches) <= 64 * 64 and sorted(Counter(map(head.__getitem__, range(10**6))).values())[-1] <= 15_874


def test_sharding_odd(spark, odd_docs, odd_rows, no_docs):
    got = sharding.shard_groups(odd_docs, F.col("text"), F.col("n_chars"), 3).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in odd_rows), key=repr)
    by = defaultdict(set)
    for r in got:
        by[r["group_key"]].add(r["shard"])
    assert all(len(s) == 1 for s in by.values()) and "row:3" in by and "row:null" in by
    assert sharding.shard_groups(no_docs, F.col("text"), F.col("n_chars")).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_groups(odd_docs, F.col("text"), F.col("n_chars"), 0)


def fewest_packs(sizes, capacity):
    """By trying all orders."""
    best = len(sizes)
    for order in itertools.permutations(sizes):
        room, n = 0, 0
        for x in order:
            if x > room:
                n, room = n + 1, capacity
            room -= x
        best = min(best, n)
    return best


def valid(rows, capacity):
    packs, slots, parts = defaultdict(int), set(), set()
    for r in rows:
        packs[r["pack_id"]] += r["length"]
        slots.add((r["pack_id"], r["slot"]))
        parts.add((r["doc_id"], r["part"]))
        assert r["start"] == r["part"] * capacity
    assert len(slots) == len(rows) and max(packs.values(), default=0) <= capacity
    assert sorted(packs) == list(range(len(packs)))
    return packs


@pytest.mark.parametrize("seed", range(6))
def test_packing_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 16) for _ in range(7)]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "doc_id long, s long").withColumn("text", F.lit("x"))
    rows = packing.best_fit_pack(df, 16, 16, 3, length=F.col("s")).collect()
    packs = valid(rows, 16)
    assert sorted((r["doc_id"], r["length"]) for r in rows) == sorted(enumerate(sizes))
    assert fewest_packs(sizes, 16) <= len(packs) <= fewest_packs(sizes, 16) + 1


def test_packing_of_shared_and_missing_ids(spark):
    """Rows of one id with other lengths of one bin, and rows without an id, are placed once each, alike in every run."""
    rows = [(7, 100 + k % 5) for k in range(60)] + [(None, 50 + k % 3) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, s long").withColumn("text", F.lit("x")).repartition(4)
    one, two = (packing.best_fit_pack(df, 256, 4, 3, length=F.col("s")).collect() for _ in range(2))
    valid(one, 256)
    assert sorted((r["doc_id"] or 0, r["length"]) for r in one) == sorted((d or 0, s) for d, s in rows)
    key = lambda rs: sorted(map(tuple, (r for r in rs if r["doc_id"] is not None)))
    assert key(one) == key(two)


def test_plan_uses_every_length_once():
    rng = random.Random(3)
    for _ in range(20):
        bins = rng.choice([8, 16, 32])
        histogram = {k: rng.randint(0, 10 ** rng.randint(0, 6)) for k in range(1, bins + 1)}
        plan = packing.plan(histogram, bins, 3)
        used = Counter()
        for content, n in plan:
            assert sum(content) <= bins and n > 0
            for x in content:
                used[x] += n
        assert used == Counter({k: n for k, n in histogram.items() if n})
        packs, total = sum(n for _, n in plan), sum(k * n for k, n in histogram.items())
        assert packs <= 1.35 * total / bins + bins + sum(n for k, n in histogram.items() if k > bins // 2)


def test_patterns_and_nnls():
    assert packing.patterns(4, 3) == [(4,), (3, 1), (2, 2), (2, 1, 1)]
    rng = np.random.default_rng(0)
    a = rng.random((6, 9))
    x = np.maximum(rng.normal(size=9), 0)
    got = packing.nnls(a, a @ x, 20_000)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-3


def test_packing_documents_and_odd(spark, odd_docs, no_docs):
    rows = packing.best_fit_pack(odd_docs, 2048, 128).collect()
    valid(rows, 2048)
    long = sorted((r["part"], r["length"]) for r in rows if r["doc_id"] == 6)
    assert sum(n for _, n in long) == 30_001 and [p for p, _ in long] == list(range(15))
    ids = Counter(r["doc_id"] for r in rows)
    assert 3 not in ids and 4 not in ids and 5 not in ids and ids[2] == 2 and ids[None] == 1
    assert packing.best_fit_pack(no_docs).collect() == []
    with pytest.raises(ValueError):
        packing.best_fit_pack(no_docs, 100, 64)
