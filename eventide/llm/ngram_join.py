"""Exact Jaccard self-join on word n-gram sets, with documents grouped by prefix."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.common import cut, fresh, mix, pieces, release

#: The most n-grams whose frequency is told to every task (12 bytes each). It orders prefixes; results don't depend on it.
MOST_FREQUENT = 1_000_000
#: Documents below which a count isn't worth telling.
LEAST_DF = 8
#: Low bits of hashes that are left out where sets are compared: 48 bits tell the n-grams of two documents apart.
SENT = np.uint64(16)
#: The second half of a set's hash.
SALT = 0x5851F42D4C957F2D
#: Bits that are left of the elements of prefixes, at least.
TOKEN_BITS = 32
#: Prefix entries that one reducer takes, on average.
RANGE_POSTINGS = 2_000_000
#: Up to so many rows, small tables of the join are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Sets that one cell of a large cluster takes, on average.
CELL_SETS = 4096
#: Pairs of sets that one cell of a dense cluster takes, on average.
CELL_PAIRS = 250_000
#: Pairs that a task works on at once.
PAIRS = 500_000
#: Postings of shared elements that a task looks for pairs in at once, besides those of the last element.
MEET_POSTINGS = 500_000
#: Ranges of postings from which the pairs' counts come in more blocks than ranges, as pairs grow faster than the input.
BLOCK_RANGES = 50
#: Characters of texts for each range of hashes that are counted.
RANGE_CHARS = 20_000_000
#: Characters whose words are hashed at once.
CHARS = 1_000_000
#: The most bits of the filter that says which groups have candidates.
BLOOM_BITS = 1 << 28


@functools.cache
def _word_characters() -> np.ndarray:
    """Whether each code point belongs to words, as WORD has it."""
    return np.array([c == 95 or chr(c).isalnum() for c in range(0x110000)], dtype=bool)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, list[int]]:
    """64-bit hashes of all words of the texts, in lower case and in a row, and the number of words of each text.

    Works on arrays of code points, so that no string is made of a word.
    """
    low = [t.lower() for t in texts]
    chars = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _word_characters()[chars]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, dtype=np.uint64), [0] * len(texts)
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    size = np.diff(np.append(first, len(at)))
    place = (np.arange(len(at)) - np.repeat(first, size)).astype(np.uint64)
    h = mix(np.add.reduceat(mix(chars[at] + (place << np.uint64(32)) + np.uint64(0x9E37)), first))
    ends = np.cumsum([len(t) + 1 for t in low])
    return h, np.diff(np.searchsorted(at[first], ends), prepend=0).tolist()


def gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; a text of fewer words has one, of all of them."""
    h, lengths = word_hashes(texts)
    grams = np.full(max(len(h) - n + 1, 0), n * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
    for k in range(n):
        grams = mix(grams * np.uint64(3) + h[k : k + len(grams)])
    out, at = [], 0
    for m in lengths:
        if m >= n:
            x = np.sort(grams[at : at + m - n + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif m:
            x = np.array([m * 0x9E3779B97F4A7C15 % 2**64], dtype=np.uint64)
            for k in range(m):
                x = mix(x * np.uint64(3) + h[at + k : at + k + 1])
            out.append(x)
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += m
    return out


def prefix_length(size: int, t: float) -> int:
    """How many of its first elements a set must share one of with any partner of Jaccard ``t``."""
    return size - math.ceil(t * size - 1e-9) + 1


def _cut_tokens(x: np.ndarray, drop: np.uint64) -> tuple[np.ndarray, int]:
    """Prefix elements cut to their leading bits, each once, and how many fell together."""
    short = np.unique(x >> drop)
    return short, len(x) - len(short)


def _by_two(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the distinct rows of two columns, and which of them each row is."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.empty(0, dtype=bool)
    number = np.empty(len(a), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _set_hash(x: np.ndarray, salt: int) -> int:
    total = mix(x + np.uint64(salt)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(x))], dtype=np.uint64)).view(np.int64)[0])


def _pack(x: np.ndarray) -> bytes:
    """A sorted uint64 array as compressed differences, byte by byte."""
    d = np.diff(x, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _rows(schema: pa.Schema, **columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def _frame(x: np.ndarray) -> bytes:
    """The rows of an int64 table, compressed byte by byte."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8 * x.shape[1]).T).tobytes(), 1)


def _framed(b: bytes, columns: int) -> int:
    """How many rows ``_frame`` was given."""
    return zstandard.frame_content_size(b) // (8 * columns)


def _unframe(b: bytes, columns: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8 * columns, -1).T).view(np.int64)


class Frequencies:
    """The frequent n-grams' counts, looked up by the top 32 bits of the hash."""

    def __init__(self, keys: np.ndarray, df: np.ndarray) -> None:
        self.keys, self.df = keys, df

    def of(self, x: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(x), dtype=np.int64)
        k = (x >> np.uint64(32)).astype(np.uint32)
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.df[i], 0)

    def prefix(self, x: np.ndarray, t: float) -> np.ndarray:
        """The first elements of the set ``x`` by frequency, then hash, the rare ones first."""
        return x[np.argsort(self.of(x), kind="stable")][: prefix_length(len(x), t)]


def _frequencies(texts: DataFrame, n: int, ranges: int) -> tuple[Frequencies, int]:
    """Document counts of all n-grams, of which the most frequent are kept; and the number of set elements.

    Hashes are counted by ranges of their values, at least ``ranges`` of them, and as many more as the texts are long.
    """
    ranges = max(ranges, int(texts.agg(F.sum(F.length("t"))).first()[0] or 0) // RANGE_CHARS)
    schema = pa.schema([("r", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("total", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, total = [], 0

        def emit() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(have), return_counts=True)
            edge = np.searchsorted(keys, np.array([((k << 32) + ranges - 1) // ranges for k in range(1, ranges)], dtype=np.uint64))
            parts = [(k, a, c) for k, (a, c) in enumerate(zip(np.split(keys, edge), np.split(counts, edge))) if len(a)]
            small = [zstandard.compress(np.minimum(c, 2**32 - 1).astype(np.uint32).tobytes(), 1) for _, _, c in parts]
            return _rows(schema, r=[k for k, _, _ in parts], keys=[_pack(a.astype(np.uint64)) for _, a, _ in parts], counts=small, total=[int(c.sum()) for _, _, c in parts])

        for batch in batches:
            for _, part in pieces(batch, "t", CHARS):
                for x in gram_sets(part, n):
                    if len(x):
                        have.append((x >> np.uint64(32)).astype(np.uint32))
                        total += len(x)
                if total > 6_000_000:
                    yield emit()
                    have, total = [], 0
        if total:
            yield emit()

    out = pa.schema([("total", pa.int64()), ("keys", pa.binary()), ("df", pa.binary())])

    def merge(group: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack(b.as_py()) for b in group.column("keys")])
        counts = np.concatenate([np.frombuffer(zstandard.decompress(b.as_py()), dtype=np.uint32) for b in group.column("counts")]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint64(1)))
        df = np.add.reduceat(counts, first)
        much = df >= LEAST_DF
        total = int(counts.sum())
        return pa.table({"total": [total], "keys": [keys[first][much].astype(np.uint32).tobytes()], "df": [df[much].tobytes()]}, schema=out)

    merged = cut(texts.mapInArrow(count, "r int, keys binary, counts binary, total long").repartitionById(ranges, F.col("r")).groupBy("r").applyInArrow(merge, "total long, keys binary, df binary"))
    levels = pa.schema([("level", pa.int32()), ("n", pa.int64())])

    def by_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(64 * 8, dtype=np.int64)
        for batch in batches:
            for b in batch.column("df"):
                df = np.frombuffer(b.as_py(), dtype=np.int64)
                seen += np.bincount((np.log2(df) * 8).astype(int), minlength=len(seen))[: len(seen)]
        hit = np.flatnonzero(seen)
        yield _rows(levels, level=hit.tolist(), n=seen[hit].tolist())

    total = merged.agg(F.sum("total")).first()[0] or 0
    room, least = MOST_FREQUENT, 64 * 8
    for level, m in sorted(merged.mapInArrow(by_level, "level int, n long").groupBy("level").agg(F.sum("n")).collect(), reverse=True):
        if m > room:
            break
        room, least = room - m, level

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, b in zip(batch.column("keys"), batch.column("df")):
                keys, df = np.frombuffer(k.as_py(), dtype=np.uint32), np.frombuffer(b.as_py(), dtype=np.int64)
                on = (np.log2(df) * 8).astype(int) >= least
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array([keys[on].tobytes()], pa.binary()), pa.array([df[on].tobytes()], pa.binary())], names=["keys", "df"])

    got = merged.mapInArrow(pick, "keys binary, df binary").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], dtype=np.uint32) for r in got] or [np.empty(0, np.uint32)])
    df = np.concatenate([np.frombuffer(r["df"], dtype=np.int64) for r in got] or [np.empty(0, np.int64)])
    order = np.argsort(keys)
    return Frequencies(keys[order], df[order]), total


def _token_pairs(tok: np.ndarray, group: np.ndarray, sizes: np.ndarray, t: float, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of groups that share a token and whose sizes allow Jaccard ``t``; ``tok`` ascends, sizes, then groups, ascend within a token.

    The partner of an entry lies further on in the run of its token and isn't larger than its size / t, so
    each entry has a range of partners. Ranges are written out some ``PAIRS`` at a time, those of one block of left groups after the
    other and all of a left group at once, so that no pair comes in two portions. A left group has no more pairs than there are entries.
    """
    ends = np.append(np.flatnonzero(np.diff(tok)) + 1, len(tok))
    starts = np.concatenate([[0], ends[:-1]])
    run_end = np.repeat(ends, ends - starts)
    # one ascending key for (token run, size) finds where the allowed sizes end
    run = np.repeat(np.arange(len(ends), dtype=np.int64), ends - starts)
    span = int(sizes.max(initial=0)) + 2
    key = run * span + sizes
    limit = np.minimum(np.floor(sizes / t + 1e-9).astype(np.int64), span - 1)
    stop = np.minimum(np.searchsorted(key, run * span + limit, side="right"), run_end)
    many = np.maximum(stop - np.arange(len(tok)) - 1, 0)
    order = np.lexsort((group, block[group]))
    last = np.append(np.flatnonzero(np.diff(group[order])) + 1, len(order))
    total = np.concatenate([[0], np.cumsum(many[order])])
    at = done = 0
    while at < len(order):
        done = max(int(np.searchsorted(total[last], total[at] + PAIRS, side="right")), done + 1)
        to = int(last[done - 1])
        m = many[order[at:to]]
        if (k := int(m.sum())):
            left = np.repeat(order[at:to], m)
            right = left + 1 + np.arange(k) - np.repeat(total[at:to] - total[at], m)
            yield group[left], group[right]
        at = to


def _token_slices(tok: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of slices of ascending tokens, of some ``most`` entries; no token is in two."""
    start = 0
    while start < len(tok):
        end = start + most
        end = int(np.searchsorted(tok, tok[end - 1], side="right")) if end < len(tok) else len(tok)
        yield start, end
        start = end


def _picked(names: list[tuple[int, bytes]], used: np.ndarray) -> np.ndarray:
    """The rows numbered ``used``, which ascend, of framed tables of three columns, each with the number of its first row."""
    edge = np.searchsorted(used, [base for base, _ in names] + [np.iinfo(np.uint32).max])
    return np.concatenate([_unframe(b, 3)[used[i:j] - base] for (base, b), i, j in zip(names, edge, edge[1:]) if i < j])


def _candidates(texts: DataFrame, n: int, t: float, freq, elements: int) -> DataFrame:
    """(a, b): pairs of prefix groups, a = b for one of several sets, whose common prefix elements allow Jaccard ``t``.

    Postings hold groups, not documents: a task posts a group's prefix once for all its sets. Elements are cut to 32 bits or more;
    how many of a prefix fall together so is added to the bound, so that none is lost. Pairs are written and added up in portions, so that
    the memory of a task is that of its range of postings, or of the different pairs of its block, however often these meet. Only a slice of
    a range is worked on at once, and blocks are more than in proportion to the input, as pairs are.
    """
    postings = max(1, int(elements * (1 - t)) + 1)
    ranges = max(1, math.ceil(postings / RANGE_POSTINGS))
    parts = max(1, min(ranges, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    blocks, at_once = parts * math.ceil(ranges / BLOCK_RANGES), MEET_POSTINGS
    drop = np.uint64(64 - min(64, max(TOKEN_BITS, postings.bit_length() + TOKEN_BITS // 4)))
    # r: a range of elements; from ``ranges`` on, a part of the groups with their least and greatest set
    schema = pa.schema([("r", pa.int32()), ("tok", pa.binary()), ("idx", pa.binary()), ("names", pa.binary())])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = freq.value
        have: list[np.ndarray] = []
        names: dict[tuple[int, int], int] = {}
        who: list[tuple[int, int, int, int, int]] = []

        def emit() -> pa.RecordBatch:
            tok = np.concatenate(have)
            idx = np.repeat(np.arange(len(have), dtype=np.uint32), [len(x) for x in have])
            o = np.argsort(tok)
            tok, idx = tok[o], idx[o]
            edge = np.searchsorted(tok, np.array([((k << (64 - int(drop))) + ranges - 1) // ranges for k in range(1, ranges)], dtype=np.uint64))
            table = np.array(who, dtype=np.int64).reshape(-1, 5)
            rows: dict[str, list] = {"r": [], "tok": [], "idx": [], "names": []}
            for k, (x, i) in enumerate(zip(np.split(tok, edge), np.split(idx, edge))):
                if len(x):
                    used, local = np.unique(i, return_inverse=True)
                    small = local.astype(np.uint16) if len(used) < 65536 else local.astype(np.uint32)
                    for c, v in zip(rows, (k, _pack(x), small.tobytes(), _frame(table[used, :3]))):
                        rows[c].append(v)
            part = (table[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.int64)
            for k in np.unique(part):
                for c, v in zip(rows, (ranges + int(k), None, None, _frame(table[part == k]))):
                    rows[c].append(v)
            return _rows(schema, **rows)

        held = 0
        for batch in batches:
            for _, part in pieces(batch, "t", CHARS):
                for x in gram_sets(part, n):
                    if len(x):
                        p = order.prefix(x, t)
                        g, s = _set_hash(p, len(x)), _set_hash(x, 0)
                        at = names.setdefault((g, len(x)), len(names))
                        if at == len(who):
                            # a prefix has the least hashes of those that are equally frequent: mixed, they are spread over the ranges
                            short, lost = _cut_tokens(mix(p), drop)
                            who.append((g, len(x), lost, s, s))
                            have.append(short)
                            held += len(short)
                        else:
                            old = who[at]
                            who[at] = (*old[:3], min(old[3], s), max(old[4], s))
                if held > 2_000_000:
                    yield emit()
                    have, names, who, held = [], {}, [], 0
        if held:
            yield emit()

    met = pa.schema([("k", pa.int32()), ("names", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])

    def block_of(groups: np.ndarray) -> np.ndarray:
        return (np.ascontiguousarray(groups[:, 0]).view(np.uint64) % np.uint64(blocks)).astype(np.int64)

    def packed(a: np.ndarray, b: np.ndarray, counts: np.ndarray, groups: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        """Pairs of rows of ``groups`` (hash, size, lost) and the counts of their common elements, by the block of the first."""
        order = np.lexsort((b, a, block[a]))
        a, b, counts = a[order], b[order], counts[order].astype(np.uint32)
        block = block[a]
        rows: dict[str, list] = {f.name: [] for f in met}
        for k, i, j, c in zip(*(np.split(x, np.flatnonzero(np.diff(block)) + 1) for x in (block, a, b, counts))):
            if len(k):
                used, local = np.unique(np.concatenate([i, j]), return_inverse=True)
                small = local.astype(np.uint32)
                for f, v in zip(rows, (int(k[0]), _frame(groups[used]), _shrink(_steps(small[: len(i)])), _shrink(_steps(small[len(i) :])), _shrink(c))):
                    rows[f].append(v)
        return _rows(met, **rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks, idx, names, whole, base = [], [], [], [], 0
        for batch in batches:
            for r, x, i, w in zip(*(batch.column(c) for c in ("r", "tok", "idx", "names"))):
                if r.as_py() >= ranges:
                    whole.append(_unframe(w.as_py(), 5))
                    continue
                toks.append(_unpack(x.as_py()))
                names.append((base, w.as_py()))
                raw = i.as_py()
                idx.append(np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * len(toks[-1]) else np.uint32).astype(np.uint32) + np.uint32(base))
                base += _framed(names[-1][1], 3)
        if whole:
            who = np.concatenate(whole)
            whole.clear()
            order = np.argsort(who[:, 0], kind="stable")
            who = who[order]
            first = np.flatnonzero(np.concatenate([[True], who[1:, 0] != who[:-1, 0]]))
            # a group has several sets if the least isn't the greatest; groups of one hash count as one
            many = first[np.minimum.reduceat(who[:, 3], first) != np.maximum.reduceat(who[:, 4], first)]
            own, groups = np.arange(len(many)), np.ascontiguousarray(who[many, :3])
            yield packed(own, own, who[many, 1], groups, block_of(groups))
        if not toks:
            return
        tok, at = np.concatenate(toks), np.concatenate(idx)
        toks.clear()
        idx.clear()
        o = np.argsort(tok, kind="stable")
        tok, at = tok[o], at[o]
        same = np.diff(tok) == 0
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        tok, at = tok[shared], at[shared]
        del o, same, shared
        for start, end in _token_slices(tok, at_once):
            # the names of a slice's groups alone are held as numbers
            used, place = np.unique(at[start:end], return_inverse=True)
            who = _picked(names, used)
            first, inverse = _by_two(who[:, 0], who[:, 1])
            groups, g = who[first], inverse[place]
            del who, used, place, inverse
            size_of, x = groups[:, 1], tok[start:end]
            o = np.lexsort((g, size_of[g], x))
            x, g = x[o], g[o]
            new = np.concatenate([[True], (np.diff(x) != 0) | (np.diff(g) != 0)])
            x, g = x[new], g[new]
            block = block_of(groups)
            for left, right in _token_pairs(x, g, size_of[g], t, block):
                pairs, counts = np.unique(left * len(groups) + right, return_counts=True)
                del left, right
                yield packed(pairs // len(groups), pairs % len(groups), counts, groups, block)

    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = np.empty((0, 3), dtype=np.int64)
        i, j, common = (np.empty(0, dtype=np.int64) for _ in range(3))
        names, a, b, c = [], [], [], []
        base = held = 0

        def fold() -> None:
            nonlocal who, i, j, common, base, held
            every = np.concatenate([who, *names])
            first, number = _by_two(every[:, 0], every[:, 1])
            pair, inverse = np.unique(number[np.concatenate([i, *a])] * len(first) + number[np.concatenate([j, *b])], return_inverse=True)
            common = np.bincount(inverse.ravel(), weights=np.concatenate([common, *c]), minlength=len(pair)).astype(np.int64)
            i, j, who = pair // max(len(first), 1), pair % max(len(first), 1), every[first]
            base, held = len(who), 0
            for x in (names, a, b, c):
                x.clear()

        for batch in batches:
            for n_, a_, b_, c_ in zip(*(batch.column(x) for x in ("names", "a", "b", "c"))):
                names.append(_unframe(n_.as_py(), 3))
                a.append(_sums(_grow(a_.as_py())) + base)
                b.append(_sums(_grow(b_.as_py())) + base)
                c.append(_grow(c_.as_py()))
                base += len(names[-1])
                held += len(c[-1])
                if held > max(PAIRS, len(i)):
                    fold()
        fold()
        size, lost = who[:, 1], who[:, 2]
        # what isn't common within both prefixes is common after the prefix that ends first
        rest = np.ceil(t * np.maximum(size[i], size[j]) - 1e-9) - 1 + np.minimum(lost[i], lost[j])
        on = (i == j) | (who[i, 0] == who[j, 0]) | (common + rest >= np.ceil(t / (1 + t) * (size[i] + size[j]) - 1e-9))
        yield _rows(out, a=who[i[on], 0], b=who[j[on], 0])

    found = texts.mapInArrow(post, "r int, tok binary, idx binary, names binary").repartitionById(ranges + parts, F.col("r")).groupBy("r").applyInArrow(meet, "k int, names binary, a binary, b binary, c binary")
    # groups of one hash and other sizes give a pair twice
    return found.groupBy("k").applyInArrow(tally, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shrink(x: np.ndarray) -> bytes:
    """An array of uint32, compressed byte by byte."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of an array of uint32, modulo 2 ** 32, from which ``_sums`` makes it again."""
    return np.diff(x, prepend=np.uint32(0))


def _sums(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x.astype(np.uint32), dtype=np.uint32).astype(np.int64)


def _grow(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _bloom(keys: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the long column g as packed bits, built in parts on the executors."""
    bits = min(BLOOM_BITS, 1 << max(10, (16 * n).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for at in _bloom_bits(batch.column("g").to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(on, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        if on.any():
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(on.tobytes(), 1)], pa.binary())], names=["b"])

    total = np.zeros(bits // 8, dtype=np.uint8)
    for row in keys.coalesce(16).mapInArrow(fill, "b binary").toLocalIterator():
        total |= np.frombuffer(zstandard.decompress(row["b"]), dtype=np.uint8)
    return total


def _bloom_bits(g: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    x = g.astype(np.int64).view(np.uint64)
    for k in range(4):
        x = mix(x + np.uint64(k + 1))
        yield (x % np.uint64(bits)).astype(np.int64)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number in each number's connected part, for the edges a-b."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            return label


def _similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, t: float, most: int = 2_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of a set, numbers of its partners, Jaccard) for those candidate pairs a-b that reach ``t``; partners are looked up many at once."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    fit = np.minimum(size[a], size[b]) >= t * np.maximum(size[a], size[b]) - 1e-9
    order = np.argsort(a[fit], kind="stable")
    a, b = a[fit][order], b[fit][order]
    for at, to in zip(*(np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))[k:][: len(a)] for k in (0, 1))):
        p = int(a[at])
        x = sets[p]
        total = np.cumsum(size[b[at:to]])
        for q in np.split(b[at:to], np.unique(np.searchsorted(total, np.arange(most, total[-1], most)))):
            if len(q):
                y = np.concatenate([sets[k] for k in q])
                hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[q]) - size[q])
                j = common / (len(x) + size[q] - common)
                on = j >= t - 1e-12
                yield p, q[on], j[on]


def _cell_pairs(start: np.ndarray, end: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the members of slices ``one`` and ``two``, each pair once if these are one slice, some ``PAIRS`` at a time; slice k has the members from ``start[k]`` to ``end[k]``."""
    many = (end - start)[one]
    total = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < len(one):
        to = max(int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1, at + 1)
        row = np.repeat(np.arange(at, to), many[at:to])
        left = start[one[row]] + np.arange(len(row)) - (total[row] - total[at])
        begin = np.where(one[row] == two[row], left + 1, start[two[row]])
        partners = end[two[row]] - begin
        upto = np.concatenate([[0], np.cumsum(partners)])
        i = 0
        while i < len(row):
            k = max(int(np.searchsorted(upto, upto[i] + PAIRS, side="right")) - 1, i + 1)
            m = partners[i:k]
            yield np.repeat(left[i:k], m), np.repeat(begin[i:k] - upto[i:k] + upto[i], m) + np.arange(int(m.sum()))
            i = k
        at = to


def _places(g: np.ndarray, k: np.ndarray, groups: pa.ChunkedArray, slices: pa.ChunkedArray) -> np.ndarray:
    """Which of the distinct rows (g, k), in ascending order, each pair of the two columns is; the number of these for one that isn't there."""
    found = []
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, dtype=np.int64)
    span = int(k.max(initial=0)) + 2
    key = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(g)))) * span + k
    for x, y in zip(groups.chunks, slices.chunks):
        x, y = x.to_numpy(), y.to_numpy().astype(np.int64)
        i = np.searchsorted(g[first], x)
        there = (g[first][np.minimum(i, len(first) - 1)] == x) & (y < span) if len(g) else np.zeros(len(x), dtype=bool)
        want = i * span + y
        at = np.searchsorted(key, want)
        there &= key[np.minimum(at, len(key) - 1)] == want if len(g) else False
        found.append(np.where(there, at, len(g)).astype(np.int32))
    return np.concatenate([np.empty(0, dtype=np.int32), *found])


def _small(df: DataFrame) -> DataFrame:
    """``df``, which is written already, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


SET = ["s1", "s2"]


def similar_sets(docs: DataFrame, n: int = 3, t: float = 0.5, text: str = "text", doc_id: str = "doc_id", pairs: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The join on distinct n-gram sets: members, sets, and links.

    Members are (d, s1, s2): each id once for each of its sets, which go by 128-bit hashes, null for rows without
    words. Sets are (s1, s2, rep, n): the smallest of their ids and how many they have. Links are
    (a1, a2, b1, b2, jaccard), one row per similar pair of different sets. Without ``pairs``, they come summed up, by the blocks in which
    sets were compared, and written: (rep, s1, s2, links, r_rep, r1, r2), the number of ids in similar sets, and a set with which this one hangs together.

    Sets that hang together meet in one block, unless these are many: a cluster of more than ``CELL_SETS`` sets, or so many pairs that cells of
    ``CELL_PAIRS`` are smaller, is cut into cells of a grid,
    each with the sets of two buckets, so that no task holds more of a cluster, however large it or a prefix group is.
    """
    if not 0 < t <= 1 or n < 1:
        raise ValueError("the threshold must lie in (0, 1], and n be at least 1")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where(F.col("d").isNotNull())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, elements = _frequencies(rows.select("t"), n, partitions)
    freq = spark.sparkContext.broadcast(found)
    release(spark)
    met = cut(_candidates(rows.select("t"), n, t, freq, elements))
    release(spark)
    ends = met.select(F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("o")), F.struct(F.col("b").alias("g"), F.col("a").alias("o")))).alias("x")).select("x.*")
    root = cut(ends.groupBy("g").agg(F.min("o").alias("o")).select("g", F.least("g", "o").alias("root")))
    bloom = spark.sparkContext.broadcast(_bloom(root.select("g"), root.count()))
    schema = pa.schema([("g", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("d", pa.int64()), ("x", pa.binary())])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, on = freq.value, bloom.value
        given: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column("d").to_pylist()
            for start, part in pieces(batch, "t", CHARS):
                sets = gram_sets(part, n)
                full = [k for k, x in enumerate(sets) if len(x)]
                name = {k: (_set_hash(sets[k], 0), _set_hash(sets[k], SALT)) for k in full}
                g = {k: _set_hash(order.prefix(sets[k], t), len(sets[k])) for k in full}
                hit = np.ones(len(full), dtype=bool)
                for at in _bloom_bits(np.array([g[k] for k in full], dtype=np.int64), 8 * len(on)):
                    hit &= on[at >> 3] & (np.uint8(128) >> (at & 7).astype(np.uint8)) > 0
                send = {k for k, h in zip(full, hit.tolist()) if h}
                out: dict[str, list] = {f.name: [] for f in schema}
                for k in range(len(sets)):
                    s = name.get(k, (None, None))
                    x = None
                    if k in send and s not in given:
                        given.add(s)
                        x = _pack(sets[k] >> SENT)
                    for c, v in zip(out, (g.get(k), *s, ids[start + k], x)):
                        out[c].append(v)
                yield _rows(schema, **out)

    sent = cut(rows.mapInArrow(members, "g long, s1 long, s2 long, d long, x binary"))
    own = cut(sent.select("d", *SET).distinct())
    sets = cut(own.where("s1 IS NOT NULL").groupBy(*SET).agg(F.min("d").alias("rep"), F.count("*").alias("n")))
    held = sent.where("x IS NOT NULL").select("g", *SET, "x")
    names = cut(held.select("g", *SET).distinct())
    # a group of many sets comes in slices, a cluster of many sets in buckets of slices
    of_group = names.groupBy("g").agg(F.ceil(F.count("*") / CELL_SETS).cast("int").alias("m"), F.count("*").alias("w"))
    info = cut(root.join(of_group, "g"))
    both = met.join(info.select(F.col("g").alias("a"), F.col("root").alias("ra"), F.col("m").alias("ma"), F.col("w").alias("wa")), "a")
    both = cut(both.join(info.select(F.col("g").alias("b"), F.col("root").alias("rb"), F.col("m").alias("mb"), F.col("w").alias("wb")), "b").withColumn("root", F.least("ra", "rb")))
    weight = both.select("root", F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("wa").alias("w")), F.struct(F.col("b").alias("g"), F.col("wb").alias("w")))).alias("x")).select("root", "x.g", "x.w").distinct()
    by_pairs = both.groupBy("root").agg(F.ceil(F.sqrt(2 * F.sum(F.col("wa").cast("double") * F.col("wb")) / CELL_PAIRS)).alias("p"))
    by_sets = weight.groupBy("root").agg(F.ceil(F.sum("w") / CELL_SETS).alias("s"))
    large = cut(by_sets.join(by_pairs, "root").select("root", F.greatest("s", "p").cast("int").alias("buckets")).where("buckets > 1"))
    both = both.join(_small(large), "root", "left")
    slices = both.select("a", "b", "root", "mb", F.coalesce("buckets", F.lit(1)).alias("buckets"), F.explode(F.expr("sequence(0, ma - 1)")).alias("sa"))
    slices = slices.select("a", "b", "root", "buckets", "sa", F.explode(F.expr("sequence(0, mb - 1)")).alias("sb")).where("a <> b OR sa <= sb")
    one, two = (F.pmod(F.xxhash64(g, s), F.col("buckets")) for g, s in (("a", "sa"), ("b", "sb")))
    compared = both.agg(F.sum(F.col("wa").cast("double") * F.col("wb"))).first()[0] or 0
    blocks = max(partitions, elements // RANGE_POSTINGS, int(compared / CELL_PAIRS))
    keyed = cut(slices.select("a", "sa", "b", "sb", F.pmod(F.xxhash64("root", F.least(one, two), F.greatest(one, two)), F.lit(blocks)).cast("int").alias("k")))
    where = cut(keyed.select(F.col("k").alias("block"), F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("sa").alias("slice")), F.struct(F.col("b").alias("g"), F.col("sb").alias("slice")))).alias("x")).select("block", "x.*").distinct())
    several = cut(info.where("m > 1").select("g", "m"))
    few = _small(where)
    release(spark)

    def placed(rows: DataFrame) -> DataFrame:
        cells = rows.join(_small(several), "g", "left").withColumn("slice", F.pmod(F.xxhash64(*SET), F.coalesce("m", F.lit(1))).cast("int"))
        return cells.join(few, ["g", "slice"])

    texts = placed(held).select("block", "g", "slice", *SET, F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("n"), "x")
    facts = placed(names.join(sets, SET)).select("block", "g", "slice", *SET, "rep", "n", F.lit(None).cast("binary").alias("x"))
    if pairs:
        result = pa.schema([("a1", pa.int64()), ("a2", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64()), ("jaccard", pa.float64())])
        ddl = "a1 long, a2 long, b1 long, b2 long, jaccard double"
    else:
        result = pa.schema([(c, pa.int64()) for c in ("rep", "s1", "s2", "links", "r_rep", "r1", "r2")])
        ddl = ", ".join(f"{c} long" for c in result.names)

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        number: dict[tuple[int, int], int] = {}
        data: list[np.ndarray | None] = []
        reps, ids, home = [], [], []
        for g, k, s1, s2, rep, m, x in zip(*(right.column(c).to_pylist() for c in ("g", "slice", "s1", "s2", "rep", "n", "x"))):
            i = number.setdefault((s1, s2), len(number))
            if i == len(data):
                home.append((g, k))
                for c in (data, reps, ids):
                    c.append(None)
            if x is None:
                reps[i], ids[i] = rep, m
            elif data[i] is None:
                data[i] = _unpack(x)
        sets = len(data)
        g, k = np.array(home, dtype=np.int64).reshape(-1, 2).T
        slices, of = _by_two(g, k)
        member = np.argsort(of, kind="stable")
        # the last slice, of no set, is for those whose sets have come with another group
        start, end = (np.append(np.searchsorted(of[member], np.arange(len(slices)), side=side), sets) for side in ("left", "right"))
        one, two = (_places(g[slices], k[slices], left.column(c), left.column(d)) for c, d in (("a", "sa"), ("b", "sb")))
        key = np.array(list(number), dtype=np.int64).reshape(-1, 2)
        ids, reps = np.array(ids, dtype=np.int64), np.array(reps, dtype=np.int64)
        links, label, found = np.zeros(sets), np.arange(sets), []
        for p, q in _cell_pairs(start, end, one, two):
            hits = list(_similar(data, member[p], member[q], t))
            if not hits:
                continue
            a = np.repeat(np.array([p for p, _, _ in hits], dtype=np.int64), [len(q) for _, q, _ in hits])
            b = np.concatenate([q for _, q, _ in hits])
            if pairs:
                found.append(pa.table([*map(pa.array, (*key[a].T.copy(), *key[b].T.copy(), np.concatenate([x for _, _, x in hits])))], schema=result))
            else:
                links += np.bincount(a, weights=ids[b], minlength=sets) + np.bincount(b, weights=ids[a], minlength=sets)
                label = _labels(sets, np.concatenate([a, np.arange(sets)]), np.concatenate([b, label]))
        if pairs:
            return pa.concat_tables([result.empty_table(), *found])
        on = np.flatnonzero(links)
        top = label[on]
        return pa.table([*map(pa.array, (reps[on], *key[on].T.copy(), links[on].astype(np.int64), reps[top], *key[top].T.copy()))], schema=result)

    links = keyed.groupBy("k").cogroup(texts.unionByName(facts).groupBy("block")).applyInArrow(verify, ddl)
    return own, sets, links if pairs else cut(links)


def ngram_jaccard_join(docs: DataFrame, n: int = 3, t: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All pairs of documents whose sets of word ``n``-grams have Jaccard ``t`` or more: (doc_a, doc_b, jaccard).

    Words are runs of letters, digits and underscores in lower case; doc_a < doc_b. The join is exact, up
    to collisions of 48-bit hashes within two documents and of 128-bit hashes of sets. N-grams are ordered by their number of documents, the rare ones first;
    documents of one set size and one prefix form a group. Groups that share a prefix element, are of fit
    sizes and have enough elements in common are candidates, and the sets of their members are compared.
    No posting list, group or partner list is capped. The pairs of n copies are n * (n - 1) / 2 rows;
    ``jaccard_classes`` says the same in a row per document.

    Frequencies are counted over the whole table; tasks are told the ``MOST_FREQUENT`` most frequent
    n-grams at most, which orders prefixes but has no bearing on results.

    A text of fewer than ``n`` words has one n-gram, of all its words. Null, empty or wordless text: in no
    pair. Null doc_id: in no pair. Rows that repeat an id with one text count once; an id with several
    texts is paired by each of them, never with itself. Empty table: empty result. Other columns are
    ignored.
    """
    own, _, links = similar_sets(docs, n, t, text, doc_id)
    left, right = own.where("s1 IS NOT NULL").selectExpr("d AS x", "s1 AS a1", "s2 AS a2"), own.selectExpr("d AS y", "s1 AS b1", "s2 AS b2")
    same = left.join(right, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("x") < F.col("y"))).select("x", "y", F.lit(1.0).alias("jaccard"))
    other = links.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).where("x <> y").select("x", "y", "jaccard")
    pairs = same.unionByName(other).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))
    return pairs.distinct()


def _set_classes(own: DataFrame, sets: DataFrame, summary: DataFrame, by_id: bool) -> DataFrame:
    """(s1, s2, rep, n, links, keeper) of the sets with two ids or more, or with links; keeper is the first set (rep, s1, s2) of those that hang together.

    With ``by_id``, the sets of one id hang together too.
    """
    node = F.struct("rep", *SET)
    # of the comparison of sets, its result alone stays
    release(own.sparkSession)
    edges = summary.select(node.alias("u"), F.struct(F.col("r_rep").alias("rep"), F.col("r1").alias("s1"), F.col("r2").alias("s2")).alias("v")).where("u <> v")
    if by_id:
        twice = cut(own.where("s1 IS NOT NULL").groupBy("d").agg(F.count("*").alias("sets")).where("sets > 1").select("d"))
        if not twice.isEmpty():
            theirs = own.join(_small(twice), "d", "left_semi").join(sets, SET).select("d", node.alias("u"))
            edges = edges.unionByName(theirs.join(theirs.groupBy("d").agg(F.min("u").alias("v")), "d").select("u", "v").where("u <> v"))
    joined = components(cut(edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()))
    links = summary.groupBy(*SET).agg(F.sum("links").alias("links"))
    keeper = joined.select(F.col("doc_id.s1").alias("s1"), F.col("doc_id.s2").alias("s2"), "keeper")
    out = sets.join(links, SET, "left").join(keeper, SET, "left")
    out = out.select(*SET, "rep", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("keeper", node).alias("keeper"))
    return cut(out.where((F.col("n") > 1) | (F.col("links") > 0) | (F.col("keeper") != node)))


def jaccard_classes(docs: DataFrame, n: int = 3, t: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The join of ``ngram_jaccard_join`` in a row per document: (doc_id, class_id, n_links).

    ``n_links`` is the number of documents with which the join pairs this one, and ``class_id`` the smallest id of all documents
    that hang together by pairs. Copies aren't expanded into pairs, and links between different texts are counted
    where they are found, so that rows are as many as documents.

    Every id has a row; one with no partner, or null, empty or wordless text, is its own class with 0 links. Null ids: no
    row. Rows that repeat an id with one text count once. An id with several texts has one row: its class holds the
    partners of all of them, and the links of its texts are added up, those between them too. Empty table: empty result. Other columns are ignored.
    """
    own, sets, summary = similar_sets(docs, n, t, text, doc_id, pairs=False)
    known = _set_classes(own, sets, summary, by_id=True)
    joined = own.join(_small(known), SET, "left")
    every = joined.select("d", F.coalesce("keeper.rep", "d").alias("class_id"), F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).alias("n_links"))
    return every.groupBy(F.col("d").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def near_duplicate_groups(docs: DataFrame, n: int = 3, t: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Connected documents of the join: (doc_id, keeper), for all of a group but its keeper, the smallest id. Cases as for ``jaccard_classes``."""
    found = jaccard_classes(docs, n, t, text, doc_id)
    return found.where("class_id <> doc_id").select("doc_id", F.col("class_id").alias("keeper"))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, keeper) of the graph with edges (hi, lo), by alternating large and small stars."""
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(root, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where(F.col("hi") != F.col("lo")).unionByName(root.select("hi", F.col("m").alias("lo"))).distinct()
        new = cut(small)
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            return new.select(F.col("hi").alias("doc_id"), F.col("lo").alias("keeper"))
        edges = new


def _with_sets(docs: DataFrame, n: int, text: str, names: tuple[str, str]) -> DataFrame:
    """``docs`` with the two hashes of each row's set, null without words."""
    at = [c.lower() for c in docs.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for _, part in pieces(batch, at, CHARS) for x in gram_sets(part, n)]
            more = [pa.array([_set_hash(x, salt) if len(x) else None for x in sets], pa.int64()) for salt in (0, SALT)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])
    return docs.mapInArrow(run, schema)


def keep_one(docs: DataFrame, n: int = 3, t: float = 0.5, text: str = "text", doc_id: str = "doc_id", broadcast_ids: int = 4_000_000) -> DataFrame:
    """``docs`` without near duplicates: of all texts that hang together by the join, that of the smallest id stays.

    Rows that repeat an id of one text leave one row. Texts of one id that differ are judged each, so a
    row goes only if its own text has a copy that stays. Rows with null id or without words stay. The ids to
    drop are broadcast while there are at most ``broadcast_ids`` of them, else joined by shuffle. Columns
    stay as they are, whatever their names. Empty table: empty result.
    """
    key, again = docs[doc_id], fresh(docs, "repeated_id")
    gone, g1, g2 = (fresh(docs, c) for c in ("dropped_id", "dropped_s1", "dropped_s2"))
    own, sets, summary = similar_sets(docs, n, t, text, doc_id, pairs=False)
    known = _set_classes(own, sets, summary, by_id=False)
    drop = own.join(_small(known), SET).where((F.col("keeper") != F.struct("rep", *SET)) | (F.col("d") != F.col("rep")))
    drop = cut(drop.select(F.col("d").alias(gone), F.col("s1").alias(g1), F.col("s2").alias(g2)))
    rows = docs.select(key.cast("long").alias(again)).where(F.col(again).isNotNull())
    twice = cut(rows.groupBy(again).agg(F.count("*").alias("rows")).where("rows > 1").select(again))
    small = lambda x: F.broadcast(x) if x.count() <= broadcast_ids else x
    drop_ids, many = small(drop), not twice.isEmpty()
    if not many:
        return docs.join(drop_ids, key.cast("long") == F.col(gone), "left_anti")
    twice = small(twice)
    once = docs.join(twice, key.cast("long") == F.col(again), "left_anti")
    once = once.join(drop_ids, once[doc_id].cast("long") == F.col(gone), "left_anti")
    s1, s2 = fresh(docs, "set_s1"), fresh(docs, "set_s2")
    more = _with_sets(docs.join(twice, key.cast("long") == F.col(again), "left_semi"), n, text, (s1, s2))
    more = more.join(drop_ids, (more[doc_id].cast("long") == F.col(gone)) & (F.col(s1) == F.col(g1)) & (F.col(s2) == F.col(g2)), "left_anti").drop(s1, s2)
    return once.unionByName(more.dropDuplicates([doc_id, text]))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x FROM w),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS k FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT doc_a, doc_b FROM c JOIN s p ON p.doc_id = doc_a JOIN s q ON q.doc_id = doc_b WHERE k / (p.n + q.n - k) >= 0.5 - 1e-12),
e AS (SELECT doc_a AS a, doc_b AS b FROM l UNION ALL SELECT doc_b, doc_a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a),
d AS (SELECT a, count(*) AS n FROM e GROUP BY a),
m AS (SELECT doc_id, min(m) AS class_id FROM r GROUP BY doc_id)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM m LEFT JOIN d ON d.a = m.doc_id
"""
