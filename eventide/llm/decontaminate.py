"""Benchmark decontamination: BM25 over an inverted index of test items, by block-max WAND."""

from __future__ import annotations

import functools
import math
import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import WORD, pieces

K1, B = 1.2, 0.75
#: Items in one block of the index, and the most blocks; beyond that blocks get larger.
BLOCK, MOST_BLOCKS = 2, 128
#: Items, and words of them, that one broadcast may hold; more are searched in several passes. A word takes some 30 bytes.
INDEX_ITEMS, INDEX_WORDS = 20_000, 2_000_000
#: Items of up to so many words are searched in passages of one length, those of up to WIDER times as many in longer ones, and so on.
SHORT, WIDER = 64, 4
_SPLIT = re.compile(r"(?s)^(.*[.?!])\s+(\S.*)$")


def question_answer(text: str) -> tuple[str, str]:
    """An item's last sentence with words is its answer, what precedes is the question; a lone one is both."""
    m = _SPLIT.match(text.strip())
    while m and not WORD.search(m[2]):
        text = m[1]
        m = _SPLIT.match(text.strip())
    return (m[1], m[2]) if m and WORD.search(m[1]) else (text, text)


def bigrams(words: list[str]) -> set[tuple[str, ...]]:
    """Distinct pairs of neighbours; of a single word, the word."""
    return set(zip(words, words[1:])) if len(words) != 1 else {(words[0],)}


class Statistics:
    """Of all items of a benchmark: how many have each word, and their mean length."""

    def __init__(self, words: list[list[str]]) -> None:
        self.n, self.mean = len(words), sum(map(len, words)) / max(len(words), 1)
        self.df = Counter(chain.from_iterable(map(set, words)))

    def idf(self, word: str) -> float:
        return math.log(1 + (self.n - self.df[word] + 0.5) / (self.df[word] + 0.5))


class Lists:
    """Lists of numbers, one behind the other in one array."""

    def __init__(self, lists: list[list], kind: str) -> None:
        self.begin = array("q", [0])
        self.flat = array(kind)
        for x in lists:
            self.flat.extend(x)
            self.begin.append(len(self.flat))

    def __getitem__(self, k: int) -> array:
        return self.flat[self.begin[k] : self.begin[k + 1]]


class Index:
    """Posting lists of the items with impacts as shares of each item's score for itself, and each term's bounds in those blocks where it occurs."""

    def __init__(self, items: list[tuple[int | None, str]], statistics: Statistics | None = None, window: int = 0) -> None:
        words = [WORD.findall(t.lower()) for _, t in items]
        statistics = statistics or Statistics(words)
        self.window = window or max(map(len, words), default=1)
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, own in enumerate(words):
            impact = {w: statistics.idf(w) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(own) / statistics.mean)) for w, n in Counter(own).items()}
            total = math.fsum(impact.values())
            for w, x in impact.items():
                lists[w].append((k, x / total))
        self.block = max(BLOCK, -(-len(self.ids) // MOST_BLOCKS))
        self.n_blocks = max(1, -(-len(self.ids) // self.block))
        self.vocabulary = {w: k for k, w in enumerate(lists)}
        self.items, self.impacts = Lists([[i for i, _ in p] for p in lists.values()], "i"), Lists([[x for _, x in p] for p in lists.values()], "d")
        bounds: list[dict[int, float]] = []
        for p in lists.values():
            own_bounds: dict[int, float] = {}
            for i, x in p:
                own_bounds[i // self.block] = max(own_bounds.get(i // self.block, 0.0), x)
            bounds.append(own_bounds)
        self.blocks, self.bounds = Lists([list(x) for x in bounds], "i"), Lists([list(x.values()) for x in bounds], "d")
        self.most = array("d", [max(x.values()) for x in bounds])

    def bound(self, term: int, block: int) -> float:
        """The most that a term adds to an item of a block."""
        lo, hi = self.blocks.begin[term], self.blocks.begin[term + 1]
        k = bisect_left(self.blocks.flat, block, lo, hi)
        return self.bounds.flat[k] if k < hi and self.blocks.flat[k] == block else 0.0

    @functools.cached_property
    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the terms' blocks begin, the blocks, and the bounds."""
        return np.frombuffer(self.blocks.begin, dtype=np.int64), np.frombuffer(self.blocks.flat, dtype=np.int32), np.frombuffer(self.bounds.flat, dtype=np.float64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("arrays", "known")}

    def sides(self, item: int) -> list[set[tuple[str, ...]]]:
        """The word pairs of an item's question and answer, made when an item is first found."""
        known = self.__dict__.setdefault("known", {})
        if item not in known:
            if len(known) >= 4096:
                known.clear()
            known[item] = [bigrams(WORD.findall(x.lower())) for x in question_answer(self.texts[item])]
        return known[item]

    def wand(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items that score ``least`` or more for the distinct ``terms``, by block-max WAND."""
        items, begin = self.items.flat, self.items.begin
        at = [(items[begin[w]], begin[w], w) for w in terms]
        found, block = [], self.block
        while at:
            at.sort()
            total = 0.0
            for k, (item, _, w) in enumerate(at):
                total += self.most[w]
                if total >= least:
                    break
            else:
                return found
            pivot = item
            while k + 1 < len(at) and at[k + 1][0] == pivot:
                k += 1
            b = pivot // block
            if sum([self.bound(w, b) for _, _, w in at[: k + 1]]) < least:
                # nothing in this block can do: go past it, or to the next list that would add to it
                target = (b + 1) * block
                if k + 1 < len(at):
                    target = max(min(target, at[k + 1][0]), pivot + 1)
                upto = k + 1
            elif at[0][0] == pivot:
                score = math.fsum(self.impacts.flat[j] for _, j, _ in at[: k + 1])
                if score >= least:
                    found.append((pivot, score))
                target, upto = pivot + 1, k + 1
            else:
                target, upto = pivot, k + 1
            moved = []
            for n, (item, j, w) in enumerate(at):
                if n < upto and item < target:
                    j = bisect_left(items, target, j, begin[w + 1])
                    if j == begin[w + 1]:
                        continue
                    item = items[j]
                moved.append((item, j, w))
            at = moved
        return found

    def search(self, words: list[list[str]], least: float, question: float, answer: float) -> list[dict[int, tuple[int, float, float, float]]]:
        """For the words of each text its verified items: {item: (passages, best score, question and answer overlap)}."""
        n, s = [len(w) for w in words], self.window
        out: list[dict[int, tuple[int, float, float, float]]] = [{} for _ in words]
        if not self.ids or not sum(n):
            return out
        flat = np.fromiter(map(self.vocabulary.get, chain.from_iterable(words), repeat(-1)), dtype=np.int64, count=sum(n))
        halves = [-(-m // s) for m in n]
        first = np.concatenate([[0], np.cumsum(halves)])
        begin = np.concatenate([[0], np.cumsum(n)])
        text_of = np.repeat(np.arange(len(words)), n)
        half = first[text_of] + (np.arange(len(flat)) - begin[text_of]) // s
        on = flat >= 0
        size = len(self.vocabulary)
        pairs = np.unique(half[on] * size + flat[on])
        half, term = pairs // size, pairs % size
        if not len(half):
            return out
        begins, blocks, bounds = self.arrays
        sums = np.zeros((first[-1] + 1, self.n_blocks))
        many = begins[term + 1] - begins[term]
        total = np.concatenate([[0], np.cumsum(many)])
        at = 0
        while at < len(term):  # some millions of bounds at a time
            to = max(at + 1, int(np.searchsorted(total, total[at] + 4_000_000, side="right")) - 1)
            k = np.repeat(begins[term[at:to]] - total[at:to], many[at:to]) + np.arange(total[at], total[to])
            cell = np.repeat((half[at:to] - half[at]) * self.n_blocks, many[at:to]) + blocks[k]
            rows = int(half[to - 1] - half[at]) + 1
            sums[half[at] : half[at] + rows] += np.bincount(cell, weights=bounds[k], minlength=rows * self.n_blocks).reshape(rows, -1)
            at = to
        # a passage is two neighbouring halves; the bound counts a term of both twice
        hopeful = np.flatnonzero((sums[:-1] + sums[1:]).max(axis=1) >= least - 1e-9)
        owner = np.searchsorted(first, hopeful, side="right") - 1
        for h, d in zip(hopeful.tolist(), owner.tolist()):
            k = h - int(first[d])
            if k and k == halves[d] - 1:
                continue  # the last half alone belongs to the passage before
            own = words[d][k * s : (k + 2) * s]
            a, e = np.searchsorted(half, [h, h + 2 if k + 1 < halves[d] else h + 1])
            hits = self.wand(np.unique(term[a:e]).tolist(), least - 1e-12)
            if hits:
                have = bigrams(own) | {(w,) for w in own}
                for item, score in hits:
                    q, r = (len(x & have) / max(len(x), 1) for x in self.sides(item))
                    if q >= question - 1e-12 and r >= answer - 1e-12:
                        m, best, q0, r0 = out[d].get(item, (0, 0.0, 0.0, 0.0))
                        out[d][item] = (m + 1, max(best, score), max(q, q0), max(r, r0))
        return out


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = INDEX_ITEMS, most_words: int = INDEX_WORDS) -> list[list[Index]]:
    """Indexes of the items that have words, by classes of length, in groups that are broadcast together; a benchmark is collected, its statistics cover all of it."""
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(text)).where(F.col(text).isNotNull()).collect()
    items = sorted(((i, t) for i, t in rows if WORD.search(t)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    lengths = [len(WORD.findall(t.lower())) for _, t in items]
    statistics = Statistics([WORD.findall(t.lower()) for _, t in items])
    classes: dict[int, list[int]] = defaultdict(list)
    for k, n in enumerate(lengths):
        c = 0
        while n > SHORT * WIDER**c:
            c += 1
        classes[c].append(k)
    groups: list[list[tuple[list[int], int]]] = []
    room = room_words = 0
    for c in sorted(classes):
        part: list[int] = []
        window = max(lengths[k] for k in classes[c])
        for k in classes[c]:
            if not groups or room < 1 or room_words < lengths[k] and room < most:
                groups.append([])
                room, room_words, part = most, most_words, []
            if not part:
                groups[-1].append((part, window))
            part.append(k)
            room, room_words = room - 1, room_words - lengths[k]
    return [[Index([items[k] for k in part], statistics, window) for part, window in group] for group in groups]


def find_contamination(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, question: float = 0.5, answer: float = 0.5, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", index_items: int = INDEX_ITEMS) -> DataFrame:
    """Test items in documents: (doc_id, item_id, n_passages, bm25, question_overlap, answer_overlap).

    Test items form an inverted index with block maxima. Every passage of every document queries it: with
    m the words of the longest item, passages have 2 m words and start every m, so that each run of m
    words lies in one. Items of up to 64 words, of up to 256 and so on, four times as many each, have passages of their
    own, so that a long item doesn't make passages long for short ones. All items with a BM25 score of at least ``least`` times what the item scores for
    itself are retrieved by WAND with block maxima, and verified: the passage must have ``question`` of the
    distinct word pairs of the item's question and ``answer`` of those of its answer. The block bounds are
    tested for all passages of a batch at once; only passages that pass one go through the lists.

    Words are runs of letters, digits and underscores in lower case. The answer is the item's last
    sentence that has words, the question all before; a lone one is both. The index is broadcast, ``index_items``
    items and ``INDEX_WORDS`` words of them at a time, in lists as long as the items; documents aren't shuffled.

    Null or wordless text, of documents or items: no result. Null ids are kept. Repeated rows are reported
    each, and so are items of one text. Empty tables: empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    names = ["doc_id", "item_id", "n_passages", "bm25", "question_overlap", "answer_overlap"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    ddl = "doc_id long, item_id long, n_passages long, bm25 double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], ddl)
    for k, group in enumerate(indexes(benchmark, item_id, item_text, index_items)):
        shared = spark.sparkContext.broadcast(group)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("d").to_pylist()
                for start, part in pieces(batch, "t"):
                    words = [WORD.findall(t.lower()) for t in part]
                    found = [
                        (ids[start + i], index.ids[j], m, round(b, 6), round(q, 6), round(r, 6))
                        for index in shared.value for i, hits in enumerate(index.search(words, least, question, answer)) for j, (m, b, q, r) in hits.items()
                    ]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found), types)], names=names)

        got = rows.mapInArrow(scan, ddl)
        out = out.unionByName(got) if k else got
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, question: float = 0.5, answer: float = 0.5, text: str = "text", item_id: str = "item_id", item_text: str = "text", index_items: int = INDEX_ITEMS) -> DataFrame:
    """The rows of ``docs`` in which ``find_contamination`` finds no item; all columns stay, nothing is shuffled.

    Rows are judged one by one, so null and repeated ids don't matter; rows without words stay. Empty tables: nothing to
    judge, or nothing goes. Extra columns pass through, whatever their names.
    """
    for group in indexes(benchmark, item_id, item_text, index_items):
        shared = docs.sparkSession.sparkContext.broadcast(group)
        at = [c.lower() for c in docs.columns].index(text.lower())

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits: list[bool] = []
                for _, part in pieces(batch, at):
                    words = [WORD.findall(t.lower()) for t in part]
                    each = [index.search(words, least, question, answer) for index in shared.value]
                    hits += [any(h) for h in zip(*each)]
                yield batch.filter(pa.array([not h for h in hits], type=pa.bool_())) if any(hits) else batch

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


SQL = r"""
WITH i AS (SELECT item_id, row_number() OVER () AS k, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws,
             CASE WHEN regexp_matches(trim(text), '(?s)^(.*[.?!])\s+(\S.*)$') THEN regexp_extract(trim(text), '(?s)^(.*[.?!])\s+(\S.*)$', 1) ELSE text END AS q,
             CASE WHEN regexp_matches(trim(text), '(?s)^(.*[.?!])\s+(\S.*)$') THEN regexp_extract(trim(text), '(?s)^(.*[.?!])\s+(\S.*)$', 2) ELSE text END AS a
           FROM benchmark WHERE text IS NOT NULL),
b AS (SELECT * FROM i WHERE len(ws) > 0),
z AS (SELECT count(*) AS n, avg(len(ws)) AS mean, max(len(ws)) AS m FROM b),
f AS (SELECT k, len(ws) AS l, w, count(*) AS tf FROM (SELECT k, ws, unnest(ws) AS w FROM b) GROUP BY ALL),
e AS (SELECT w, count(*) AS df FROM f GROUP BY w),
x AS (SELECT k, w, ln(1 + (z.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean)) AS v FROM f JOIN e USING (w) CROSS JOIN z),
p AS (SELECT k, w, v / sum(v) OVER (PARTITION BY k) AS v FROM x),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL),
c AS (SELECT r, doc_id, h, ws[h * m + 1 : (h + 2) * m] AS ps
      FROM (SELECT *, unnest(range(0, greatest(CAST(ceil(len(ws) / m) AS BIGINT) - 1, 1))) AS h FROM d CROSS JOIN z WHERE len(ws) > 0) ),
t AS (SELECT r, h, unnest(list_distinct(ps)) AS w FROM c),
s AS (SELECT r, h, k, sum(v) AS score FROM t JOIN p USING (w) GROUP BY 1, 2, 3 HAVING sum(v) >= 0.5 - 1e-12),
y AS (SELECT k, item_id, regexp_extract_all(lower(q), '[\p{L}\p{N}_]+') AS qw, regexp_extract_all(lower(a), '[\p{L}\p{N}_]+') AS aw FROM b),
g AS (SELECT k, item_id, CASE WHEN len(qw) = 1 THEN qw ELSE list_distinct(list_transform(range(1, len(qw)), lambda j: qw[j] || ' ' || qw[j+1])) END AS qg,
             CASE WHEN len(aw) = 1 THEN aw ELSE list_distinct(list_transform(range(1, len(aw)), lambda j: aw[j] || ' ' || aw[j+1])) END AS ag FROM y),
o AS (SELECT s.r, c.doc_id, s.h, s.k, g.item_id, s.score, qg, ag,
             list_concat(ps, list_transform(range(1, len(ps)), lambda j: ps[j] || ' ' || ps[j+1])) AS pg
      FROM s JOIN c ON c.r = s.r AND c.h = s.h JOIN g ON g.k = s.k),
u AS (SELECT *, len(list_intersect(qg, pg)) / greatest(len(qg), 1) AS qo, len(list_intersect(ag, pg)) / greatest(len(ag), 1) AS ao FROM o)
SELECT doc_id, item_id, count(*) AS n_passages, round(max(score), 6) AS bm25, round(max(qo), 6) AS question_overlap, round(max(ao), 6) AS answer_overlap
FROM u WHERE qo >= 0.5 - 1e-12 AND ao >= 0.5 - 1e-12 GROUP BY r, doc_id, k, item_id
"""
