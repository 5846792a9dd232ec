"""Pattern packing by non-negative least squares."""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventide.llm.common import cut

SLICES = 256
COLUMNS = "doc_id long, part long, start long, length long, pack_id long, slot long"


def patterns(bins: int, most: int) -> list[tuple[int, ...]]:
    """All multisets of at most ``most`` lengths in 1..bins that fill a pack exactly, longest first."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, top: int, have: tuple[int, ...]) -> None:
        if left == 0:
            out.append(have)
        elif len(have) < most:
            for x in range(min(left, top), 0, -1):
                if x * (most - len(have)) < left:
                    break
                grow(left - x, x, (*have, x))

    grow(bins, bins, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Minimise |a x - b| over x >= 0 by accelerated projected gradients with restarts."""
    gram, target = a.T @ a, a.T @ b
    v = np.ones(len(gram))
    for _ in range(30):
        v = gram @ v
        v /= np.linalg.norm(v) or 1.0
    rate = 1.0 / max(float(v @ gram @ v) * 1.01, 1e-12)
    x = y = np.zeros(len(gram))
    t = 1.0
    scale = max(float(np.abs(target).max(initial=0)), 1e-12)
    for _ in range(steps):
        new = np.maximum(0.0, y - rate * (gram @ y - target))
        if (y - new) @ (new - x) > 0:  # the momentum points uphill
            t, y = 1.0, new
        else:
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y = new + (t - 1) / t2 * (new - x)
            t = t2
        if np.abs(new - x).max(initial=0) <= 1e-10 * scale * rate:
            return new
        x = new
    return x


def plan(histogram: dict[int, int], bins: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that together hold each length just as often as the histogram has it.

    Repeat counts are fitted by NNLS and rounded; where that asks for more documents of a length than
    there are, patterns give way, and what is left over is packed best-fit decreasing, on counts.
    """
    counts = np.zeros(bins + 1, dtype=np.int64)
    for k, n in histogram.items():
        counts[k] += n
    found = patterns(bins, most)
    a = np.zeros((bins, len(found)))
    for j, p in enumerate(found):
        for x in p:
            a[x - 1, j] += 1
    total = max(int(counts.sum()), 1)
    fit = nnls(a, counts[1:] / total) * total
    left = counts.copy()
    out: list[tuple[tuple[int, ...], int]] = []
    for j in np.argsort(-fit, kind="stable"):
        n = int(round(float(fit[j])))
        if n <= 0:
            break
        need = Counter(found[j])
        n = min([n, *(int(left[x]) // c for x, c in need.items())])
        if n > 0:
            for x, c in need.items():
                left[x] -= n * c
            out.append((found[j], n))
    # best-fit decreasing over counts: open packs by room, then by content
    open_packs: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []
    for x in range(bins, 0, -1):
        n = int(left[x])
        while n:
            k = bisect.bisect_left(rooms, x)
            if k == len(rooms):
                fits = bins // x
                full, rest = divmod(n, fits)
                for content, m in (((x,) * fits, full), ((x,) * rest, 1 if rest else 0)):
                    if m:
                        room = bins - sum(content)
                        if room == 0:
                            out.append((content, m))
                        else:
                            if room not in open_packs or not open_packs[room]:
                                bisect.insort(rooms, room)
                            open_packs[room][content] += m
                n = 0
                continue
            room = rooms[k]
            content = min(open_packs[room])
            take = min(n, open_packs[room][content])
            open_packs[room][content] -= take
            if not open_packs[room][content]:
                del open_packs[room][content]
            if not open_packs[room]:
                rooms.pop(k)
            n -= take
            if room == x:
                out.append(((*content, x), take))
            else:
                if not open_packs[room - x]:
                    bisect.insort(rooms, room - x)
                open_packs[room - x][(*content, x)] += take
    for room in rooms:
        out += sorted(open_packs[room].items())
    return out


def best_fit_pack(docs: DataFrame, capacity: int = 2048, bins: int = 128, most: int = 3, text: str = "text", doc_id: str = "doc_id", length: F.Column | None = None) -> DataFrame:
    """Pack documents into sequences of ``capacity`` tokens: (doc_id, part, start, length, pack_id, slot).

    A document's length is ``length``, by default its whitespace-separated words plus one for the
    separator. A longer one is cut into parts of ``capacity``, the last shorter. Lengths are rounded up
    to one of ``bins`` steps; patterns of up to ``most`` parts that fill a pack are enumerated, their
    repeat counts are fitted to the histogram by non-negative least squares and rounded, and residuals
    are packed best-fit decreasing. Every part is placed once and no pack exceeds its capacity.

    The driver sees the histogram alone, of ``bins`` numbers at any corpus size. A part finds its pack
    from its rank among the parts of its bin, which is counted in parallel over 256 hash slices.

    Null, empty or blank text, or a length below 1, has nothing to pack: such rows are left out. Null doc_id is kept.
    Repeated rows are packed each. Equal lengths rank by hash, id, part and length. Empty table: empty result. Other columns are ignored.
    """
    if bins < 1 or most < 1 or capacity < bins or capacity % bins:
        raise ValueError("capacity must be a multiple of bins, and most at least 1")
    step = capacity // bins
    if length is None:
        words = F.regexp_count(F.col(text), F.lit(r"\S+"))
        length = F.when(words > 0, words + 1)
    # texts are read once: ids and lengths are all that is needed of them
    # rows without an id, which may be many, are spread over the slices by where they stand
    spread = F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id())
    sized = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), length.cast("long").alias("n"), spread.alias("spread"))).where(F.col("n") >= 1)
    parts = sized.select("doc_id", "n", "spread", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("part"))
    parts = parts.select("doc_id", "part", "spread", (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("long").alias("length"))
    parts = parts.withColumn("bin", F.ceil(F.col("length") / step).cast("int")).withColumn("slice", F.pmod(F.xxhash64("doc_id", "part", "spread"), F.lit(SLICES)).cast("int"))
    slices = [(r["bin"], r["slice"], r["n"]) for r in parts.groupBy("bin", "slice").agg(F.count("*").alias("n")).collect()]
    histogram: Counter = Counter()
    before = np.zeros((bins + 1, SLICES), dtype=np.int64)
    for b, s, n in sorted(slices):
        before[b, s] = histogram[b]
        histogram[b] += n
    firsts, runs = 0, defaultdict(list)  # by bin: (rank of the first, its pack, slot); ranks run through a pattern's repeats
    placed: Counter = Counter()
    for content, n in plan(histogram, bins, most):
        for slot, x in enumerate(content):
            runs[x].append((placed[x], firsts, slot))
            placed[x] += n
        firsts += n
    tables = {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for x, r in runs.items()}
    shared = docs.sparkSession.sparkContext.broadcast((before, tables))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, tables = shared.value
        for batch in batches:
            b, s, inside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bin", "slice", "inside"))
            rank = before[b, s] + inside
            pack, slot = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for x in np.unique(b):
                at = np.flatnonzero(b == x)
                begin, first, slots = tables[x]
                k = np.searchsorted(begin, rank[at], side="right") - 1
                pack[at], slot[at] = first[k] + rank[at] - begin[k], slots[k]
            own = [batch.column(c) for c in ("doc_id", "part", "start", "length")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pack), pa.array(slot)], names=["doc_id", "part", "start", "length", "pack_id", "slot"])

    inside = F.row_number().over(Window.partitionBy("bin", "slice").orderBy("doc_id", "part", "length")).cast("long") - 1
    return parts.withColumn("inside", inside).select("doc_id", "part", "start", "length", "bin", "slice", "inside").mapInArrow(place, COLUMNS)
