import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from eventide.llm import ngram_join as N
from eventide.llm.common import cut, release

DOCS = "doc_id long, text string"


def grams(text, n):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n, t):
    sets = sorted({(i, frozenset(grams(x, n))) for i, x in rows if i is not None and grams(x, n)}, key=repr)
    out = set()
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        j = len(x & y) / len(x | y)
        if a != b and j >= t - 1e-12:
            out.add((min(a, b), max(a, b), round(j, 6)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(40)]
    rows, originals = [], [[rng.choice(pool) for _ in range(rng.randint(2, 60))] for _ in range(12)]
    shared = [rng.choice(pool) for _ in range(30)]
    for k in range(n):
        w = list(rng.choice(originals))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(pool)
        if rng.random() < 0.2:
            w += shared
        rows.append((k, " ".join(w).capitalize() + rng.choice(["", "."])))
    return rows


@pytest.mark.parametrize(("seed", "n", "t", "postings"), [(1, 3, 0.5, 10**6), (2, 2, 0.8, 50), (3, 1, 0.3, 200), (4, 3, 1.0, 100), (5, 4, 0.6, 30)])
def test_join_brute_force(spark, monkeypatch, seed, n, t, postings):
    monkeypatch.setattr(N, "RANGE_POSTINGS", postings)
    monkeypatch.setattr(N, "LEAST_DF", 3)
    monkeypatch.setattr(N, "MOST_FREQUENT", 40)
    rows = corpus(seed)
    got = N.ngram_jaccard_join(spark.createDataFrame(rows, DOCS).repartition(5), n, t).collect()
    assert {tuple(r) for r in got} == brute(rows, n, t) and len(got) == len({tuple(r)[:2] for r in got})


def brute_classes(rows, n, t):
    near = brute(rows, n, t)
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    links = {i: 0 for i in root}
    for a, b, _ in near:
        links[a] += 1
        links[b] += 1
    return {(i, find(i), links[i]) for i in root}


@pytest.mark.parametrize(("seed", "cell", "told", "bits"), [(1, 4096, 500_000, 32), (2, 2, 0, 32), (3, 5, 500_000, 6), (6, 1, 0, 4)])
def test_classes_brute_force(spark, monkeypatch, seed, cell, told, bits):
    """In one cell or many, with tables joined by broadcast or shuffle, and with elements of prefixes that collide."""
    for k, v in (("CELL_SETS", cell), ("BROADCAST_ROWS", told), ("TOKEN_BITS", bits), ("RANGE_POSTINGS", 100)):
        monkeypatch.setattr(N, k, v)
    rows = [*corpus(seed), *((200 + k, x) for k, (_, x) in enumerate(corpus(seed)[:9])), (300, None), (301, "..."), (None, "w1 w2 w3 w4")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = N.jaccard_classes(df).collect()
    assert {tuple(r) for r in got} == brute_classes(rows, 3, 0.5) and len(got) == len({i for i, _ in rows if i is not None})
    assert {tuple(r) for r in N.ngram_jaccard_join(df).collect()} == brute(rows, 3, 0.5)


def test_one_prefix_of_many_sets(spark, monkeypatch):
    """Sets of one size and one prefix are cut into slices, and still all compared."""
    monkeypatch.setattr(N, "CELL_SETS", 3)
    rows = [(k, " ".join([*(f"rare{k % 2}{j}" for j in range(30)), *(f"{'xyz'[(k + j) % 3]}{j}" for j in range(10))])) for k in range(24)]
    rows += [(100 + k, f"x{k % 10} y{k} z") for k in range(20)]
    got = N.jaccard_classes(spark.createDataFrame(rows, DOCS)).collect()
    assert {tuple(r) for r in got} == brute_classes(rows, 3, 0.5)


def test_similar_against_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    a, b = (np.array(x) for x in zip(*itertools.combinations(range(40), 2)))
    for most in (1, 100, 10**6):
        got = {(p, q): j for p, qs, js in N._similar(sets, a, b, 0.4, most) for q, j in zip(qs.tolist(), js.tolist())}
        js = {(p, q): len(set(sets[p]) & set(sets[q])) / len(set(sets[p]) | set(sets[q])) for p, q in zip(a.tolist(), b.tolist())}
        assert got == {k: j for k, j in js.items() if j >= 0.4 - 1e-12}
    assert N._labels(6, np.array([4, 2, 5]), np.array([2, 1, 3])).tolist() == [0, 1, 1, 3, 1, 3]


def test_an_id_with_several_texts(spark):
    """A text goes for its own copy alone; a class holds what any text of its ids is like."""
    one, two, three = (" ".join(f"{c}{k}" for k in range(20)) for c in "abc")
    rows = [(1, one), (5, one + " more"), (5, two), (6, three), (6, three), (7, two + " end"), (9, "alone")]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, N.keep_one(df).collect())) == sorted([(1, one), (5, two), (6, three), (9, "alone")])
    assert {tuple(r) for r in N.jaccard_classes(df).collect()} == {(1, 1, 1), (5, 1, 2), (7, 1, 1), (6, 6, 0), (9, 9, 0)}


def test_many_copies_and_their_groups(spark):
    text = " ".join(f"a{k}" for k in range(50))
    other = text.replace("a7", "b7")
    rows = [(k, text) for k in range(40)] + [(100 + k, other) for k in range(3)] + [(7, text), (None, text), (500, None), (501, "alone here")]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    assert {tuple(r) for r in N.ngram_jaccard_join(df).collect()} == brute(rows, 3, 0.5)
    assert {tuple(r) for r in N.near_duplicate_groups(df).collect()} == {(k, 0) for k in [*range(1, 40), 100, 101, 102]}
    kept = sorted((r["doc_id"] for r in N.keep_one(df).collect()), key=repr)
    assert kept == sorted([0, None, 500, 501], key=repr)


@pytest.mark.parametrize("ids", [4_000_000, 0])
def test_join_odd(spark, odd_docs, odd_rows, no_docs, ids):
    rows = [r[:2] for r in odd_rows]
    assert {tuple(r) for r in N.ngram_jaccard_join(odd_docs).collect()} == brute(rows, 3, 0.5)
    kept = N.keep_one(odd_docs, broadcast_ids=ids)
    assert kept.columns == odd_docs.columns
    near = brute(rows, 3, 0.5)
    gone = {b for a, b, _ in near}
    want = [r[:2] for k, r in enumerate(odd_rows) if r[0] not in gone and (r[0] is None or r[:2] not in [x[:2] for x in odd_rows[:k]])]
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert N.ngram_jaccard_join(no_docs).collect() == [] and N.keep_one(no_docs).collect() == []
    with pytest.raises(ValueError):
        N.ngram_jaccard_join(no_docs, t=0)


def test_components(spark):
    rng = random.Random(2)
    edges = [tuple(sorted(rng.sample(range(60), 2), reverse=True)) for _ in range(45)] + [(k + 1, k) for k in range(100, 130)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {tuple(r) for r in N.components(spark.createDataFrame(sorted(set(edges)), "hi long, lo long")).collect()}
    assert got == {(x, find(x)) for x in root if find(x) != x}


def test_bounded_helpers():
    import numpy as np

    x = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (N._unpack(N._pack(x)) == x).all() and (N._grow(N._shrink(np.arange(9, dtype=np.uint32))) == np.arange(9)).all()
    assert N.prefix_length(10, 0.5) == 6 and N.prefix_length(1, 1.0) == 1


def test_pairs_come_in_portions(monkeypatch):
    """Pairs of a dense cluster are never held at once, and each comes in one portion, with all elements that it shares."""
    import tracemalloc

    import numpy as np

    n, elements = 1500, 4
    tok, group = np.repeat(np.arange(elements, dtype=np.uint64), n), np.tile(np.arange(n), elements)
    sizes, block = np.full(n * elements, 9), np.arange(n) % 7
    monkeypatch.setattr(N, "PAIRS", 50_000)
    tracemalloc.start()
    met, blocks = [], []
    for left, right in N._token_pairs(tok, group, sizes, 0.5, block):
        assert len(left) <= 50_000
        key, counts = np.unique(left * n + right, return_counts=True)
        assert (counts == elements).all()
        met.append(len(key))
        blocks.extend(np.unique(block[left]).tolist())
    assert sum(met) == n * (n - 1) // 2 and blocks == sorted(blocks)
    cells = 0
    for left, right in N._cell_pairs(np.array([0, 1000]), np.array([1000, n]), np.array([0, 0, 1]), np.array([0, 1, 1])):
        assert len(left) <= 50_000 and (left < right).all()
        cells += len(left)
    assert cells == n * (n - 1) // 2
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
    x = np.array([3, 3, 9, 0, 2**32 - 1], dtype=np.uint32)
    assert (N._sums(N._steps(x)) == x).all()
    y = np.array([[1, -2, 3], [2**62, 0, -(2**63)]])
    assert (N._unframe(N._frame(y), 3) == y).all() and N._unframe(N._frame(y[:0]), 3).shape == (0, 3)


def test_a_dense_cluster_in_cells(spark, monkeypatch):
    """A cluster of fewer sets than a cell takes, but of many pairs, is cut by its pairs."""
    monkeypatch.setattr(N, "CELL_PAIRS", 300)
    rows = [(k, " ".join([*(f"c{j}" for j in range(20)), f"own{k}"])) for k in range(150)] + [(500, "another text of its own")]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {tuple(r) for r in N.jaccard_classes(df).collect()}
    assert got == {(k, 0, 149) for k in range(150)} | {(500, 500, 0)}
    assert sorted(r["doc_id"] for r in N.keep_one(df).collect()) == [0, 500]


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (re.fullmatch(r"shuffle_(\d+)_\d+_\d+\.data", files.apply(k).getName()) for k in range(files.size()))
    return {int(m[1]) for m in names if m}


def left_of(spark, shuffles):
    """Which of the shuffles have files still when the cleaner has had time to remove them."""
    until = time.time() + 5
    while (left := shuffles & shuffle_files(spark)) and time.time() < until:
        time.sleep(0.1)
    return left


def test_release_waits_for_the_jvm(spark):
    """What Python has just dropped is garbage for the JVM, and files of its shuffles go."""
    release(spark)
    before = shuffle_files(spark)
    for _ in range(3):
        written = cut(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
        mine = shuffle_files(spark) - before
        assert mine
        release(spark)
        assert not left_of(spark, mine) and written.count() == 7


@pytest.mark.parametrize("summed", [True, False])
def test_no_shuffle_outlives_its_step(spark, monkeypatch, summed):
    """Files of the counts and candidates are gone when sets are read, those of the comparison when classes are made."""
    steps, real = [], N.release
    release(spark)
    before = shuffle_files(spark)

    def watched(session):
        mine = shuffle_files(spark) - before
        real(session)
        steps.append((len(mine), left_of(spark, mine)))

    monkeypatch.setattr(N, "release", watched)
    df = spark.createDataFrame(corpus(1), DOCS).repartition(5)
    got = N.jaccard_classes(df) if summed else N.ngram_jaccard_join(df)
    assert len(steps) == (4 if summed else 3) and all(had and not left for had, left in steps)
    assert {tuple(r) for r in got.collect()} == (brute_classes if summed else brute)(corpus(1), 3, 0.5)
