import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k, queries=None):
    out = []
    for i, q in zip(*(queries or (ids, x))):
        s = np.round((x * q).sum(axis=1), K.DIGITS) + 0.0
        found = [(-v, j) for v, j in zip(s, ids) if queries is not None or j != i]
        out += [(i, j, r + 1, -v) for r, (v, j) in enumerate(sorted(found)[:k])]
    return out


def close(got, want):
    got, want = sorted(map(tuple, got)), sorted(want)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-6)


@pytest.mark.parametrize(("seed", "norms", "bucket", "block"), [(1, "one", 30, 25), (2, "spread", 20, 50), (3, "heavy", 16, 16), (4, "ties", 10, 200), (5, "spread", 1000, 1000)])
def test_top_k_brute_force(spark, seed, norms, bucket, block):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(150, 6)) + 2 * rng.normal(size=(5, 6))[rng.integers(0, 5, 150)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "spread":
        x *= rng.uniform(0, 3, 150)[:, None]
    elif norms == "heavy":
        x *= rng.pareto(1, 150)[:, None]
    elif norms == "ties":
        x = np.round(x * 2) / 2
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    close(K.top_k_products(df, 7, bucket=bucket, block=block).collect(), brute(range(150), x, 7))


def test_queries_of_their_own(spark):
    rng = np.random.default_rng(9)
    x, q = (np.round(rng.normal(size=(n, 4)), 2).astype(np.float32).astype(np.float64) for n in (40, 9))
    make = lambda m: spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(m)], SCHEMA)
    close(K.top_k_products(make(x), 3, make(q), bucket=8, block=4).collect(), brute(range(40), x, 3, (range(9), q)))


@pytest.mark.parametrize("norms", ["one", "spread"])
def test_asked_rows_against_all(spark, norms):
    """Every fifth vector against all, in many cells of the grid."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 5))
    x *= (1 if norms == "one" else rng.pareto(1, 400)[:, None]) / np.linalg.norm(x, axis=1)[:, None]
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    got = K.top_k_products(df, 4, bucket=5, block=3, asked=F.col("id") % 5 == 0).collect()
    close(got, [r for r in brute(range(400), x, 4) if r[0] % 5 == 0])


@pytest.mark.parametrize("seed", range(10))
def test_candidates_miss_nothing(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(200, 8)) * rng.pareto(2, 200)[:, None]
    b = K.Bucket(np.arange(200), x)
    for q in rng.normal(size=(30, 8)):
        p = b.x @ q
        for least in np.quantile(p, [0.3, 0.9, 0.99, 1]):
            place = set(np.arange(200)[b.candidates(q, float(np.linalg.norm(q)), float(least))].tolist())
            assert set(np.flatnonzero(p >= least + 1e-9).tolist()) <= place


def test_top_k_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], None), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [1.0, nan], 0), (7, [1.0, inf], 0), (8, [1.0, None], 0), (9, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (10, [-1.0, 5.0], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{SCHEMA}, norm int, b int")
    got = sorted(map(tuple, K.top_k_products(df, 2).collect()))
    assert got == [(1, 2, 1, 1.0), (1, 3, 2, 0.0), (2, 1, 1, 1.0), (2, 3, 2, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0), (10, 1, 2, -1.0), (10, 3, 1, 0.0)]
    assert K.top_k_products(df.where("vec_id > 99")).collect() == [] and K.top_k_products(df.where("vec_id = 1")).collect() == []
    with pytest.raises(ValueError):
        K.top_k_products(df, 0)
