"""Quality classification by co-training of a text view and a page-metadata view."""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventide.llm.common import WORD, cut, fresh, pieces

#: The most labelled documents that models are fitted on.
MAX_LABELLED = 10_000
ROUNDS = 2
#: The part of the labelled documents' weight that pseudo-labels of a class have together; each has half of a label's weight at most.
PSEUDO = 0.5
#: Newton steps by which a view learns what it is handed, at most.
STEPS = 8
#: Up to so many rejected documents, their hashes are broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000
#: Only documents this sure are handed over.
SURE = 0.95
LEXICON = 400
_SYMBOLS = "|*$#&%!?.,;:-_=/\\<>{}()[]\"'@~^+"
HOSTS, LANGS = 32, 8
TEXT_DIM = 12 + len(_SYMBOLS) + 4
META_DIM = 6 + HOSTS + LANGS


def text_features(text: str, bad: frozenset[str], good: frozenset[str]) -> list[float]:
    """What the words and signs of a text are like, each as a share of its words or characters."""
    n = max(len(text), 1)
    words = text.split()
    m = max(len(words), 1)
    low = WORD.findall(text.lower())
    seen = set(low)
    k = max(len(low), 1)
    counts = Counter(low)
    top = max(counts.values(), default=0)
    letters = sum(map(len, low))
    upper = sum(map(str.isupper, words))
    digits = sum(map(text.count, "0123456789"))
    long = sum(len(w) > 25 for w in seen)
    hits, liked = seen & bad, len(seen & good)
    n_bad = sum(counts[w] for w in hits)
    repeats = sum(map(eq, low, low[1:]))
    return [
        upper / m, digits / n, len(seen) / k, len(seen) / k**0.5, top / k, repeats / k, letters / k, letters / n, long / k, np.log1p(k), k / m, float(not seen),
        *(np.log1p(100 * text.count(c) / n) for c in _SYMBOLS), np.log1p(n_bad), min(1.0, 10 * n_bad / k), np.log1p(len(hits)), liked / len(seen) if seen else 0.0,
    ]


def meta_features(text: str, host: str | None, lang: str | None) -> list[float]:
    """What is known of a page without reading it: size, layout of its lines, host and language."""
    n, lines = len(text), text.count("\n") + 1
    out = [np.log1p(n), np.log1p(lines), np.log1p(n / lines), float(n == 0), float(host is None), float(lang is None)]
    hosts, langs = [0.0] * HOSTS, [0.0] * LANGS
    if host is not None:
        hosts[zlib.crc32(host.encode()) % HOSTS] = 1.0
    if lang is not None:
        langs[zlib.crc32(lang.encode()) % LANGS] = 1.0
    return out + hosts + langs


class Logistic:
    """L2-regularised logistic regression on standardised features, by Newton steps; then Platt-scaled."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 2.0) -> None:
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._z(x)
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ z + l2 * np.eye(len(w))
            step = np.linalg.solve(h, z.T @ (weight * (y - p)) - l2 * w)
            w += step * min(1.0, 5.0 / (np.linalg.norm(step) + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        self.w, self.a, self.b = w, 1.0, 0.0

    def sums(self, x: np.ndarray, y: np.ndarray | float, weight: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the likelihood at the present weights, without the penalty."""
        z = self._z(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        return z.T @ (weight * (y - p)), (z * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ z

    def step(self, gradient: np.ndarray, hessian: np.ndarray, l2: float = 2.0) -> float:
        """One Newton step; how far it went."""
        step = np.linalg.solve(hessian + l2 * np.eye(len(self.w)), gradient - l2 * self.w)
        step *= min(1.0, 5.0 / (np.linalg.norm(step) + 1e-12))
        self.w = self.w + step
        return float(np.abs(step).max())

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.std, -6, 6), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.w, -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's scaling with his smoothed targets."""
        f, target = self.raw(x), np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((p - target) * f).sum() + 1e-3 * (a - 1), (p - target).sum()])
            h = np.array([[(v * f * f).sum() + 1e-3, (v * f).sum()], [(v * f).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.a, self.b = max(a, 0.0), b

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * self.raw(x) + self.b, -30, 30)


class CoTrained:
    """The two calibrated views, the lexica, and the prior; without labels, no views."""

    def __init__(self, bad: frozenset[str], good: frozenset[str]) -> None:
        self.bad, self.good, self.text, self.meta, self.prior = bad, good, None, None, 0.0

    def score(self, tx: np.ndarray, mx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by text, by metadata, and of both: views count as independent given the class."""
        t, m = self.text.logit(tx), self.meta.logit(mx)
        p = lambda x: 1 / (1 + np.exp(-x))
        return p(t), p(m), p(np.clip(t + m - self.prior, -60, 60))


def _columns(docs: DataFrame, text: str, doc_id: str, host: str, lang: str) -> DataFrame:
    have = {c.lower() for c in docs.columns}
    side = [F.col(c).cast("string").alias(a) if c.lower() in have else F.lit(None).cast("string").alias(a) for c, a in ((host, "h"), (lang, "l"))]
    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), *side)


def _keys(text: F.Column, host: F.Column, lang: F.Column) -> list[F.Column]:
    """128 bits that tell apart what scores depend on."""
    return [F.xxhash64(F.lit(salt), text, host, lang, text.isNull(), host.isNull(), lang.isNull()) for salt in (1, 2)]


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(d, t, h, l, y, part) of at most ``most`` labelled ids, by md5 of the id; part 0 is for lexica, 1 to fit, 2 to calibrate."""
    y = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 0).when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1)
    own = labels.select(F.col("doc_id").cast("long").alias("id"), y.alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.min("y").alias("y"))
    own = own.withColumn("m", F.md5(F.col("id").cast("string"))).orderBy("m", "id").limit(most)
    own = own.select("id", "y", F.pmod(F.conv(F.substring("m", 1, 6), 16, 10).cast("int"), F.lit(10)).alias("q")).withColumn("part", F.expr("CASE WHEN q < 5 THEN 0 WHEN q < 8 THEN 1 ELSE 2 END"))
    return docs.join(F.broadcast(own), docs["d"] == own["id"]).select("d", "t", "h", "l", "y", "part").dropDuplicates(["d"])


def _lexica(sample: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """The words whose presence speaks most against and most for a document, by weighted log odds."""
    words = F.array_distinct(F.split(F.lower("t"), r"[^\p{L}\p{N}_]+"))
    part = sample.where("part = 0")
    totals = {r["y"]: r["n"] for r in part.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    by = part.select("y", F.explode(words).alias("w")).where("w <> ''").groupBy("w").agg(F.sum(1 - F.col("y")).alias("b"), F.sum("y").alias("g")).where("b + g >= 4")
    odds = F.log((F.col("b") + 0.5) / (n0 + 1.0) / ((F.col("g") + 0.5) / (n1 + 1.0)))
    z = odds / F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("g") + 0.5))
    by = by.select("w", odds.alias("o"), z.alias("z"))
    bad = by.where("o > 1.5 AND z > 2.2").orderBy(F.desc("z"), "w").limit(LEXICON).select("w").collect()
    good = by.where("o < -1.5 AND z < -2.5").orderBy("z", "w").limit(LEXICON).select("w").collect()
    return frozenset(r["w"] for r in bad), frozenset(r["w"] for r in good)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _features(batch: pa.RecordBatch, model: CoTrained, text: str | int = "t", host: str | int = "h", lang: str | int = "l") -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    hosts, langs = (batch.column(c).to_pylist() if c != -1 else [None] * n for c in (host, lang))
    tx, mx = [], []
    for start, part in pieces(batch, text):
        for i, t in enumerate(part):
            tx.append(text_features(t, model.bad, model.good))
            mx.append(meta_features(t, hosts[start + i], langs[start + i]))
    return np.array(tx, dtype=np.float64).reshape(n, TEXT_DIM), np.array(mx, dtype=np.float64).reshape(n, META_DIM)


def _with_features(rows: DataFrame, model: CoTrained) -> DataFrame:
    """(d, y, part, blank, tx, mx, k1, k2)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("d", pa.int64()), ("y", pa.int32()), ("part", pa.int32()), ("blank", pa.bool_()), ("tx", pa.list_(pa.float32())), ("mx", pa.list_(pa.float32())), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                tx, mx = _features(batch, shared.value)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel().astype(np.float32))) for x in (tx, mx)]
                yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("y"), batch.column("part"), pa.array(tx[:, 11] > 0), *lists, batch.column("k1"), batch.column("k2")], schema=schema)

    k1, k2 = _keys(F.col("t"), F.col("h"), F.col("l"))
    return rows.select("*", k1.alias("k1"), k2.alias("k2")).mapInArrow(run, "d long, y int, part int, blank boolean, tx array<float>, mx array<float>, k1 long, k2 long")


def _handed(features: DataFrame, model: CoTrained, number: int, sure: float, before: tuple[list[int], list[int]] = ([], [])) -> list:
    """The surest ``number`` unlabelled documents of each view and class, over the whole table, without the ids that the view handed ``before``."""
    shared = features.sparkSession.sparkContext.broadcast(model)
    gone = [pa.array(x, pa.int64()) for x in before]
    schema = "view int, cls int, p double, d long, tx array<float>, mx array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t, m, _ = shared.value.score(_matrix(batch.column("tx"), TEXT_DIM), _matrix(batch.column("mx"), META_DIM))
            for view, p in enumerate((t, m)):
                new = ~pc.is_in(batch.column("d"), value_set=gone[view]).to_numpy(zero_copy_only=False)
                for cls, s in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero((s >= sure) & new)
                    if len(at):
                        taken = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), view, np.int32)), pa.array(np.full(len(at), cls, np.int32)), pa.array(s[at]), taken.column("d"), taken.column("tx"), taken.column("mx")], names=["view", "cls", "p", "d", "tx", "mx"])

    pool = features.where("y IS NULL AND NOT blank").select("d", "tx", "mx").mapInArrow(run, schema)
    top = F.row_number().over(Window.partitionBy("view", "cls").orderBy(F.desc("p"), "d"))
    return pool.withColumn("top", top).where(F.col("top") <= number).collect()


def _pool_sums(features: DataFrame, teachers: CoTrained, students: tuple[Logistic, Logistic], sure: float) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """By student and class: how many unlabelled documents the other view is sure of, and the sums of gradient and Hessian over all of them.

    Tasks add up what they see, and their sums are added up in 16 places, so that the driver gets as much at any size of the table.
    """
    shared = features.sparkSession.sparkContext.broadcast((teachers, students))
    dims = [len(x.w) for x in students]
    schema = pa.schema([("view", pa.int32()), ("cls", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teachers, students = shared.value
        got = {(v, c): [0, np.zeros((d + 1, d))] for v, d in enumerate(dims) for c in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            xs = _matrix(batch.column("tx"), TEXT_DIM), _matrix(batch.column("mx"), META_DIM)
            t, m, _ = teachers.score(*xs)
            for view, p in enumerate((m, t)):
                for cls, s in ((1, p), (0, 1 - p)):
                    on = s >= sure
                    if on.any():
                        g, h = students[view].sums(xs[view][on], float(cls))
                        got[view, cls][0] += int(on.sum())
                        got[view, cls][1] += np.vstack([g, h])
        place = TaskContext.get().partitionId() % 16
        rows = [(v, c, place, n, x.tobytes()) for (v, c), (n, x) in got.items() if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def add(group: pa.Table) -> pa.Table:
        first = {c: group.column(c)[0].as_py() for c in ("view", "cls", "place")}
        total = sum(np.frombuffer(b.as_py()) for b in group.column("sums"))
        return pa.Table.from_pylist([first | {"n": sum(group.column("n").to_pylist()), "sums": total.tobytes()}], schema=schema)

    ddl = "view int, cls int, place int, n long, sums binary"
    out: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]] = {}
    sums = features.where("y IS NULL AND NOT blank").select("tx", "mx").mapInArrow(run, ddl).groupBy("view", "cls", "place").applyInArrow(add, ddl)
    for r in sorted(sums.collect(), key=lambda r: (r["view"], r["cls"], r["place"])):
        x = np.frombuffer(r["sums"]).reshape(dims[r["view"]] + 1, -1)
        n, g, h = out.get((r["view"], r["cls"]), (0, 0.0, 0.0))
        out[r["view"], r["cls"]] = (n + r["n"], g + x[0], h + x[1:])
    return out


def co_train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", lang: str = "lang", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, handed: int | None = None, sure: float = SURE) -> tuple[CoTrained, DataFrame | None]:
    """Fit the two views; returns the model and the table of features of all documents.

    Each view is a logistic regression over its own features. In each of ``rounds`` rounds, both score every unlabelled
    document and hand those that they are sure of (at least ``sure``), all of them, as pseudo-labels to the other view, which
    is fitted anew on its labels and these, by Newton steps whose sums are formed where the documents are, and calibrated on labelled documents kept
    apart for that. The pseudo-labels of a class weigh ``PSEUDO`` times as much as its labels together, and each half a label at most,
    so that co-training does alike at every size of the table.

    With ``handed``, each view hands at most so many a round and class, its surest ones that it didn't hand before, at half weight.
    """
    rows = _columns(docs, text, doc_id, host, lang)
    sample = cut(_labelled(rows, labels, max_labelled))
    groups = {(r["part"], r["y"]) for r in sample.select("part", "y").distinct().collect()}
    if not all((part, y) in groups for part in (1, 2) for y in (0, 1)):
        return CoTrained(frozenset(), frozenset()), None
    model = CoTrained(*_lexica(sample))
    own = _with_features(sample.select("d", "t", "h", "l", "y", "part").where("part > 0"), model).collect()
    known = sample.select(F.col("d").alias("known"), F.col("y").alias("ky"))
    marked = rows.join(F.broadcast(known), F.col("d") == F.col("known"), "left").select("d", "t", "h", "l", F.col("ky").cast("int").alias("y"), F.lit(None).cast("int").alias("part"))
    features = cut(_with_features(marked, model))
    # in one order, so that sums don't depend on that of arrival
    own = sorted(own, key=lambda r: (r["d"], r["tx"]))
    fit, held = ([r for r in own if r["part"] == k] for k in (1, 2))
    side = lambda rs, c: np.array([r[c] for r in rs], dtype=np.float64)
    y, yc = side(fit, "y"), side(held, "y")
    model.prior = float(np.log(yc.mean() / (1 - yc.mean())))
    extra: dict[int, dict[tuple, tuple]] = {0: {}, 1: {}}  # by the view that learns from it

    def refit() -> None:
        for view, c in enumerate(("tx", "mx")):
            more = list(extra[view].values())
            x = np.concatenate([side(fit, c), np.array([v for v, _ in more]).reshape(len(more), -1)]) if more else side(fit, c)
            new = Logistic(x, np.concatenate([y, [z for _, z in more]]), np.concatenate([np.ones(len(y)), np.full(len(more), 0.5)]))
            new.calibrate(side(held, c), yc)
            setattr(model, ("text", "meta")[view], new)

    refit()
    for _ in range(rounds if handed is None else 0):
        students = copy.deepcopy((model.text, model.meta))
        for _ in range(STEPS):
            sums, far = _pool_sums(features, model, students, sure), 0.0
            for view, c in enumerate(("tx", "mx")):
                g, h = students[view].sums(side(fit, c), y)
                for cls in (0, 1):
                    n, more_g, more_h = sums.get((view, cls), (0, 0.0, 0.0))
                    weight = PSEUDO * min(1.0, float((y == cls).sum()) / max(n, 1))
                    g, h = g + weight * more_g, h + weight * more_h
                far = max(far, students[view].step(g, h))
            if far < 1e-3:
                break
        for view, c in enumerate(("tx", "mx")):
            students[view].calibrate(side(held, c), yc)
        model.text, model.meta = students
    for _ in range(rounds if handed is not None else 0):
        before = tuple([d for d, _ in extra[1 - view] if d is not None] for view in (0, 1))
        for r in _handed(features, model, handed, sure, before):
            extra[1 - r["view"]][(r["d"], r["cls"])] = (np.array(r["mx"] if r["view"] == 0 else r["tx"]), r["cls"])
        refit()
    return model, features


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", lang: str = "lang", **options) -> DataFrame:
    """Score all documents: (doc_id, text_score, meta_score, score, keep).

    A document is wanted where its label has quality 1 and isn't toxic. ``co_train`` fits a text view and
    a page-metadata view on at most ``max_labelled`` labelled documents and lets them exchange all sure
    pseudo-labels of the whole table; ``score`` is the probability that both calibrated views give
    together, and ``keep`` says that it is at least 0.5.

    Null, empty or wordless text: all scores 0, not kept. Null host or language is a feature of its own. Null ids and repeated
    rows are scored each. Of labels with null or conflicting values for an id, nulls are left out and the
    worse counts. Too few labels to fit and to calibrate both classes: scores are null and every document
    with words is kept. Empty table: empty result. Other columns are ignored.
    """
    model, features = co_train(docs, labels, text, doc_id, host, lang, **options)
    if features is None:
        rows = _columns(docs, text, doc_id, host, lang)
        blank = ~F.coalesce(F.col("t"), F.lit("")).rlike(r"[\p{L}\p{N}_]")
        zero = F.when(blank, F.lit(0.0))
        return rows.select(F.col("d").alias("doc_id"), zero.alias("text_score"), zero.alias("meta_score"), zero.alias("score"), (~blank).alias("keep"))
    return _scored(features, model).select("doc_id", "text_score", "meta_score", "score", "keep")


def _scored(features: DataFrame, model: CoTrained) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep, k1, k2)."""
    shared = features.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "text_score", "meta_score", "score", "keep", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blank = batch.column("blank").to_numpy(zero_copy_only=False)
            scores = shared.value.score(_matrix(batch.column("tx"), TEXT_DIM), _matrix(batch.column("mx"), META_DIM))
            t, m, s = (np.where(blank, 0.0, np.round(x, 6)) for x in scores)
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(t), pa.array(m), pa.array(s), pa.array((s >= 0.5) & ~blank.astype(bool)), batch.column("k1"), batch.column("k2")], names=names)

    return features.select("d", "blank", "tx", "mx", "k1", "k2").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean, k1 long, k2 long")


def keep_wanted(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", lang: str = "lang", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The rows of ``docs`` that ``quality_scores`` keeps, with all their columns and without a shuffle of texts.

    Scores depend on text, host and language alone. What is rejected is told by a hash of these, broadcast while there are at most
    ``broadcast_rows`` such; beyond that, each row's features are formed once more where it lies.

    Null, empty or wordless text: the row goes. Null ids and repeated rows are judged each. Too few labels: every row with words stays.
    Empty table: empty result. Other columns pass through, whatever their names.
    """
    model, features = co_train(docs, labels, text, doc_id, host, lang, **options)
    if features is None:
        return docs.where(F.coalesce(F.col(text), F.lit("")).rlike(r"[\p{L}\p{N}_]"))
    names = [c.lower() for c in docs.columns]
    gone = cut(_scored(features, model).where("NOT keep").select(F.col("k1").alias("rejected_1"), F.col("k2").alias("rejected_2")).distinct())
    if gone.count() <= broadcast_rows:
        have = [F.col(f"`{c}`").cast("string") if c.lower() in names else F.lit(None).cast("string") for c in (text, host, lang)]
        k1, k2 = fresh(docs, "key_1"), fresh(docs, "key_2")
        gone = gone.toDF(*(r := [fresh(docs, c) for c in ("rejected_1", "rejected_2")]))
        keyed = docs.withColumns(dict(zip((k1, k2), _keys(*have))))
        return keyed.join(F.broadcast(gone), (F.col(k1) == F.col(r[0])) & (F.col(k2) == F.col(r[1])), "left_anti").drop(k1, k2)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [names.index(c.lower()) if c.lower() in names else -1 for c in (text, host, lang)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                tx, mx = _features(batch, shared.value, *at)
                tx, mx = tx.astype(np.float32).astype(np.float64), mx.astype(np.float32).astype(np.float64)
                keep = (np.round(shared.value.score(tx, mx)[2], 6) >= 0.5) & ~(tx[:, 11] > 0)
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
