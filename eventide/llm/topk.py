"""Exact top-k inner products over norm buckets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventide.llm.common import cut

#: Vectors in a bucket, and queries in a block.
BUCKET, BLOCK = 4096, 2048
#: Coordinates that coordinate pruning looks at.
FOCUS = 4
#: Local thresholds up to this prune nothing by coordinates.
LOW_COSINE = 0.35
DIGITS = 6
_SLACK = 10.0**-DIGITS
#: The most blocks, and buckets, that one task holds.
CELL = 16
#: Queries whose products are computed at once.
AT_ONCE = 128


class Bucket:
    """Vectors of similar length, the longest first, with their directions sorted by each coordinate."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        norms = np.sqrt((x * x).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.x, self.norms = ids[order], x[order], norms[order]
        self.most = float(self.norms[0]) if len(ids) else 0.0
        unit = self.x / np.where(self.norms > 0, self.norms, 1.0)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(unit, self.order, axis=0).T)
        self.order = np.ascontiguousarray(self.order.T)

    def candidates(self, q: np.ndarray, norm: float, least: float) -> np.ndarray | slice:
        """Places of all vectors that may reach the product ``least`` with ``q`` of length ``norm``.

        The local cosine threshold is least / (norm * longest of the bucket). Above 1 nothing qualifies; up to
        ``LOW_COSINE``, vectors are pruned by length; above it, by the ranges that the threshold leaves
        to the query's largest coordinates.
        """
        if norm == 0 or self.most == 0 or least <= 0:
            return slice(0, None) if least <= 0 else slice(0, 0)
        cosine = least / (norm * self.most)
        if cosine > 1 + 1e-9:
            return slice(0, 0)
        if cosine <= LOW_COSINE:
            return slice(0, int(np.searchsorted(-self.norms, -(least / norm) * (1 - 1e-9), side="right")))
        cosine = min(cosine, 1.0)
        u = q / norm
        focus = np.argpartition(-np.abs(u), min(FOCUS, len(u)) - 1)[:FOCUS]
        best: tuple[int, int, int, int] | None = None
        ranges = []
        for f in focus:
            middle, spread = u[f] * cosine, math.sqrt(max(0.0, (1 - cosine * cosine) * (1 - u[f] * u[f]))) + 1e-9
            # a direction as close as that to u reaches further out in f the closer it may come
            high = 1.0 if u[f] >= cosine else middle + spread
            low = -1.0 if -u[f] >= cosine else middle - spread
            a, b = np.searchsorted(self.sorted[f], [low, high + 1e-9])
            ranges.append((int(b - a), int(f), int(a), int(b)))
        ranges.sort()
        best = ranges[0]
        found = self.order[best[1], best[2] : best[3]]
        for size, f, a, b in ranges[1:2]:
            if best[0] > 64 and size < 0.7 * len(self.ids):
                mask = np.zeros(len(self.ids), dtype=bool)
                mask[self.order[f, a:b]] = True
                found = found[mask[found]]
        return found


def search_block(bucket: Bucket, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, include_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, neighbour place, product) of the top ``k`` in the bucket for each query, above ``least``, its ties included.

    ``least`` rises by what the bucket itself holds.
    """
    rows, places, products = [], [], []
    norms = np.sqrt((queries * queries).sum(axis=1))
    near = np.empty((0, 0))
    for i in range(len(ids)):
        if i % AT_ONCE == 0:
            near = queries[i : i + AT_ONCE] @ bucket.x.T
        c = bucket.candidates(queries[i], float(norms[i]), float(least[i]) - 2 * _SLACK)
        place = np.arange(len(bucket.ids))[c]
        # products of many queries at once are a little off: what may reach the least, and the k-th of the bucket, is computed anew
        rough = near[i % AT_ONCE][c]
        off = _SLACK * (1 + norms[i] * bucket.most)
        lowest = least[i] - off
        if len(rough) > k + 1:
            lowest = max(lowest, np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] - off)
        place = place[rough >= lowest]
        part = bucket.x[place]
        if not len(part):
            continue
        # one sum per vector, so that equal vectors have equal products
        score = np.round(np.einsum("ij,j->i", part, queries[i]), DIGITS) + 0.0
        ok = score >= least[i] - _SLACK
        if not include_self:
            ok &= bucket.ids[place] != ids[i]
        score, place = score[ok], place[ok]
        if len(score) > k:
            cutoff = np.partition(score, len(score) - k)[len(score) - k]
            on = score >= cutoff
            score, place = score[on], place[on]
            order = np.lexsort((bucket.ids[place], -score))[:k]
            score, place = score[order], place[order]
        rows.append(np.full(len(score), i))
        places.append(place)
        products.append(score)
    if not rows:
        none = np.empty(0, dtype=np.int64)
        return none, none, np.empty(0)
    return np.concatenate(rows), np.concatenate(places), np.concatenate(products)


def top_k_products(vectors: DataFrame, k: int = 10, queries: DataFrame | None = None, vec_id: str = "vec_id", embedding: str = "embedding", bucket: int = BUCKET, block: int = BLOCK, asked: F.Column | None = None) -> DataFrame:
    """The ``k`` largest inner products of every query: (query_id, neighbor_id, rank, product).

    Exact search after norm buckets: vectors are ordered by length and cut into buckets of about
    ``bucket``; queries come in blocks. Each block first meets one bucket each of the longest vectors,
    which gives every query a threshold, the least product it still needs. Then it meets those buckets
    alone whose longest vector can reach one of its thresholds; in a bucket, a query prunes by length or by
    coordinates, as its local cosine threshold says, and products of what is left are computed. Products
    are rounded to 6 digits, ties go to the smaller id. Queries are ``queries``, or those vectors whose id
    satisfies ``asked`` (a condition on the column id), or all vectors; a vector is never its own neighbour.

    Blocks and buckets form a grid, of which a task gets a cell of up to ``CELL`` blocks and ``CELL`` buckets, so that each travels once for
    ``CELL`` of the others. Buckets are numbered by length, so those that a block can reach are the first ones up to
    some number. Nothing is broadcast.

    Null or empty embeddings, those with a null or a value that isn't finite, those of another length
    than most, and null ids take no part. The zero vector has product 0 with all. An id that
    repeats with one embedding counts once; with several, the first by value stands. Fewer than ``k`` others: fewer rows.
    Empty table: empty result. Other columns are ignored.
    """
    if k < 1:
        raise ValueError("k must be at least 1")

    def clean(df: DataFrame) -> DataFrame:
        x = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x")).where("id IS NOT NULL AND size(x) > 0")
        x = x.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
        return x.groupBy("id").agg(F.min("x").alias("x"))

    spark = vectors.sparkSession
    base = clean(vectors)
    dims = base.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    ddl = "query_id long, neighbor_id long, rank int, product double"
    if dims is None:
        return spark.createDataFrame([], ddl)
    dim = dims["dim"]
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    base = base.where(F.size("x") == dim).withColumn("norm", norm)
    n = base.count()
    n_buckets = max(1, -(-n // bucket))
    # buckets by length: quantile borders, and within equal lengths by hash, so that no bucket grows
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    cuts = base.select(F.expr(f"percentile_approx(norm, {('array(' + ','.join(str(i / 64) for i in range(1, 64)) + ')')}, 10000)")).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    level = F.lit(0)
    for c in cuts:
        level = level + F.when(F.col("norm") < c, 1).otherwise(0)
    base = cut(base.withColumn("level", level))
    sizes = {r["level"]: r["n"] for r in base.groupBy("level").agg(F.count("*").alias("n")).collect()}
    first, at = {}, 0
    for lv in sorted(sizes):
        parts = max(1, round(sizes[lv] / bucket)) if len(sizes) < n_buckets or sizes[lv] > bucket else 1
        first[lv] = (at, parts)
        at += parts
    table = F.create_map(*[F.lit(v) for lv, (a, p) in first.items() for v in (lv, a)])
    parts = F.create_map(*[F.lit(v) for lv, (a, p) in first.items() for v in (lv, p)])
    placed = base.withColumn("b", (table[F.col("level")] + F.floor(h * parts[F.col("level")])).cast("int"))
    # values travel as bytes, in the width that they came in
    kinds = [df.schema[embedding].dataType.elementType.typeName() for df in (vectors, queries) if df is not None]
    width = np.dtype(np.float32 if set(kinds) == {"float"} else np.float64)
    bucket_schema = pa.schema([("b", pa.int32()), ("most", pa.float64()), ("ids", pa.list_(pa.int64())), ("xs", pa.binary())])

    def gather(group: pa.Table) -> pa.Table:
        own = group.sort_by("id")
        norms = own.column("norm").to_numpy()
        ids, xs = own.column("id").combine_chunks(), own.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.table({"b": pa.array([group.column("b")[0].as_py()], pa.int32()), "most": [float(norms.max())], "ids": held, "xs": [xs.astype(width).tobytes()]}, schema=bucket_schema)

    buckets = cut(placed.select("b", "id", "x", "norm").groupBy("b").applyInArrow(gather, "b int, most double, ids array<long>, xs binary"))
    rows = base if asked is None else base.where(asked)
    rows = rows if queries is None else clean(queries).where(F.size("x") == dim).withColumn("norm", norm)
    n_asked = n if queries is None and asked is None else rows.count()
    n_blocks = max(1, -(-n_asked // block))
    blocks = rows.withColumn("b", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n_blocks)).cast("int"))
    blocks = cut(blocks.select("b", "id", "x", "norm").groupBy("b").applyInArrow(gather, "b int, most double, ids array<long>, xs binary"))
    include_self = queries is not None
    hit_schema = pa.schema([("query_id", pa.int64()), ("neighbor_id", pa.int64()), ("product", pa.float64())])
    # cells hold fewer blocks and buckets where there would be too few of them
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = min(CELL, max(1, at * -(-n_blocks // CELL) // tasks))

    def values(raw) -> np.ndarray:
        return np.frombuffer(raw.as_py(), dtype=width).astype(np.float64).reshape(-1, dim)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        for p_row in range(right.num_rows):
            p = Bucket(np.array(right.column("ids")[p_row].as_py(), dtype=np.int64), values(right.column("xs")[p_row]))
            for q_row in range(left.num_rows):
                first, until, skip, number = (left.column(c)[q_row].as_py() for c in ("first", "until", "skip", "b"))
                here = right.column("b")[p_row].as_py()
                if not first <= here < until or here == skip:
                    continue
                ids = np.array(left.column("ids")[q_row].as_py(), dtype=np.int64)
                least = np.array(left.column("least")[q_row].as_py() or [-math.inf] * len(ids))
                row, place, product = search_block(p, ids, values(left.column("xs")[q_row]), least, k, include_self)
                found.append((ids[row], p.ids[place], product))
        return pa.table([np.concatenate([np.empty(0, dtype=t.type.to_pandas_dtype()), *(x[c] for x in found)]) for c, t in enumerate(hit_schema)], schema=hit_schema)

    def join(asking: DataFrame) -> DataFrame:
        """What blocks (b, ids, xs, least) find in their buckets from ``first`` on and before ``until``, without ``skip``."""
        asking = asking.withColumn("row", F.floor(F.col("b") / CELL).cast("int"))
        of_block = asking.withColumn("col", F.explode(F.sequence(F.floor(F.col("first") / wide).cast("int"), F.floor((F.col("until") - 1) / wide).cast("int"))))
        cells = of_block.select(F.col("row").alias("its_row"), F.col("col").alias("its_col")).distinct()
        of_bucket = buckets.join(cells, F.floor(F.col("b") / wide) == F.col("its_col"))
        return of_block.groupBy("row", "col").cogroup(of_bucket.groupBy("its_row", "its_col")).applyInArrow(meet, "query_id long, neighbor_id long, product double")

    # each block starts with one of the buckets that make up the longest vectors
    head = max(1, min(at, first[min(first)][1]))
    start = F.pmod("b", F.lit(head)).cast("int")
    any_least = F.lit(None).cast("array<double>")
    hits = cut(join(blocks.select("b", "ids", "xs", any_least.alias("least"), start.alias("first"), (start + 1).alias("until"), F.lit(-1).alias("skip"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("product"), "neighbor_id"))
    kth = hits.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("product").alias("kth"))
    flat = blocks.select("b", F.posexplode("ids").alias("pos", "id")).join(kth, "id", "left").select("b", "pos", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    least = flat.groupBy("b").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "kth"))), lambda x: x["kth"]).alias("least"), F.min("kth").alias("lowest"))
    # the buckets of a level are in reach if its longest vector is; levels come from the longest to the shortest
    tops = {r["level"]: r["most"] for r in base.groupBy("level").agg(F.max("norm").alias("most")).collect()}
    until = F.lit(0)
    for lv in sorted(first):
        until = until + F.when(F.col("most") * F.lit(tops[lv]) >= F.col("lowest") - 3 * _SLACK, F.lit(first[lv][1])).otherwise(F.lit(0))
    rest = blocks.join(least, "b").select("b", "ids", "xs", "least", F.lit(0).alias("first"), until.cast("int").alias("until"), start.alias("skip")).where("until > 0")
    found = hits.unionByName(join(rest))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "neighbor_id", "rank", "product")


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_inner_product(a.x, b.x), 6) AS product FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0)
SELECT query_id, neighbor_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY product DESC, neighbor_id) AS INTEGER) AS rank, product
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY product DESC, neighbor_id) <= 10
"""
