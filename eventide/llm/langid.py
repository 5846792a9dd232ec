"""Word-level language identification in code-switched text by a linear-chain CRF."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventide.llm.common import WORD, cut, mix, pieces

#: The most labelled documents of each language, and words of each, that the model is fitted on.
DOCS_PER_LANG, WORDS_PER_DOC = 150, 400
#: Code-switched sequences of some 60 words that are made of them.
SEQUENCES = 800
#: The most words of the lexicon, which is counted over all labelled documents.
LEXICON_WORDS = 200_000
#: Up to so many chosen ids, over all languages, are broadcast.
BROADCAST_IDS = 1_000_000
BUCKETS = 1 << 16


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of the words, all in a row, and where each word's begin.

    Character n-grams of 1 to 3 (with both ends marked), prefixes and suffixes of 2 to 4, the whole word.
    """
    marked = [f"\x02{w}\x03" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    ends = np.cumsum(n)
    starts = ends - n
    word_of = np.repeat(np.arange(len(n)), n)
    position = np.arange(len(chars)) - starts[word_of]
    left = ends[word_of] - np.arange(len(chars))
    owners, numbers = [], []

    def add(owner: np.ndarray, value: np.ndarray, kind: int) -> None:
        owners.append(owner)
        numbers.append((mix(value + np.uint64(kind << 48)) % np.uint64(BUCKETS)).astype(np.int64))

    code, run = np.zeros(len(chars), dtype=np.uint64), chars * np.uint64(0x9E3779B97F4A7C15)
    for k in (1, 2, 3, 4):
        code = mix(code * np.uint64(31) + np.concatenate([run[k - 1 :], np.zeros(k - 1, dtype=np.uint64)])) if k > 1 else mix(run)
        inside = left >= k
        if k <= 3:
            add(word_of[inside], code[inside], k)
        if k >= 2:
            first = inside & (position == 0)
            add(word_of[first], code[first], 8 + k)
            last = left == k
            add(word_of[last], code[last], 16 + k)
    # the whole word: a sum over (character, place)
    each = mix(run + (position.astype(np.uint64) << np.uint64(40)))
    add(np.arange(len(n)), np.add.reduceat(each, starts), 32)
    owner, number = np.concatenate(owners), np.concatenate(numbers)
    order = np.argsort(owner, kind="stable")
    return number[order], np.searchsorted(owner[order], np.arange(len(n)))


class Crf:
    """A linear-chain CRF: emissions from hashed features and a lexicon, transitions, starts."""

    def __init__(self, langs: list[str], lexicon: dict[str, int]) -> None:
        k = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.weights = np.zeros((BUCKETS, k))
        self.known = np.zeros((k + 1, k))  # by the language that the lexicon gives a word, at the end none
        self.moves, self.start = np.zeros((k, k)), np.zeros(k)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each language."""
        out = np.empty((len(words), len(self.langs)))
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            number, first = word_features(part)
            size = np.diff(np.append(first, len(number)))
            for c in range(out.shape[1]):
                out[at : at + len(part), c] = np.add.reduceat(self.weights[:, c][number], first) / size
            out[at : at + len(part)] += self.known[[self.lexicon.get(w, len(self.langs)) for w in part]]
        return out

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities of each word's language by forward-backward, for many texts at once; rows of texts follow each other."""
        return self._forward_backward(emissions, lengths)[0]

    def _forward_backward(self, emissions: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        n = lengths[order]
        steps = int(n[0]) if len(n) else 0
        # live[t]: texts, the longest first, that have a word t
        live = np.searchsorted(-n, -np.arange(steps), side="left")
        e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        a = np.exp(self.moves - self.moves.max())
        alpha, beta = np.empty_like(e), np.empty_like(e)
        now = None
        for t in range(steps):
            rows = begin[: live[t]] + t
            now = (np.exp(self.start - self.start.max()) if t == 0 else now[: live[t]] @ a) * e[rows]
            now = now / now.sum(axis=1, keepdims=True)
            alpha[rows] = now
        back = np.empty((0, e.shape[1]))
        for t in range(steps - 1, -1, -1):
            rows = begin[: live[t]] + t
            if len(back) < live[t]:  # texts that end here
                back = np.concatenate([back, np.ones((live[t] - len(back), e.shape[1]))])
            beta[rows] = back
            back = (back * e[rows]) @ a.T
            back = back / back.sum(axis=1, keepdims=True)
        p = alpha * beta
        p /= p.sum(axis=1, keepdims=True)
        if not pairs:
            return p, None
        first = np.zeros(len(e), dtype=bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        to = np.flatnonzero(~first)
        xi = alpha[to - 1][:, :, None] * a[None] * (e[to] * beta[to])[:, None, :]
        xi /= xi.sum(axis=(1, 2), keepdims=True)
        return p, xi.sum(axis=0)

    def gradient(self, words: list[str], hit: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log likelihood of the labels ``y`` of sequences in a row, given the lexicon's languages ``hit``."""
        k, n = len(self.langs), len(lengths)
        number, first = word_features(words)
        size = np.diff(np.append(first, len(number)))
        e = np.add.reduceat(self.weights[number], first, axis=0) / size[:, None] + self.known[hit]
        p, xi = self._forward_backward(e, lengths, pairs=True)
        gold = np.zeros_like(p)
        gold[np.arange(len(y)), y] = 1
        diff = (gold - p) / n
        heads = np.cumsum(lengths) - lengths
        inside = np.ones(len(y), dtype=bool)
        inside[heads] = False
        seen = np.zeros((k, k))
        np.add.at(seen, (y[np.flatnonzero(inside) - 1], y[inside]), 1)
        spread = np.repeat(diff / size[:, None], size, axis=0)
        g = {"weights": np.zeros_like(self.weights), "known": np.zeros_like(self.known), "moves": (seen - xi) / n, "start": (gold[heads] - p[heads]).sum(axis=0) / n}
        for c in range(k):
            g["weights"][:, c] = np.bincount(number, weights=spread[:, c], minlength=BUCKETS)
        np.add.at(g["known"], hit, diff)
        return g

    def fit(self, sequences: list[list[tuple[str, int]]], rounds: int = 6, batch: int = 40, rate: float = 0.15, l2: float = 1e-5) -> None:
        """Adam on the likelihood of labelled sequences."""
        rng = np.random.default_rng(7)
        k = len(self.langs)
        names = ("weights", "known", "moves", "start")
        state = {c: (np.zeros_like(getattr(self, c)), np.zeros_like(getattr(self, c))) for c in names}
        step = 0
        for r in range(rounds):
            order = rng.permutation(len(sequences))
            for at in range(0, len(order), batch):
                part = [sequences[i] for i in order[at : at + batch] if sequences[i]]
                words = [w for s in part for w, _ in s]
                y = np.array([c for s in part for _, c in s])
                lengths = np.array([len(s) for s in part])
                hit = np.array([self.lexicon.get(w, k) for w in words])
                # a lexicon that knows every training word would be trusted too much: half of it is hidden
                hit = np.where(rng.random(len(hit)) < 0.5, k, hit)
                g = self.gradient(words, hit, y, lengths)
                step += 1
                for c in names:
                    m, v = state[c]
                    x = g[c] - l2 * getattr(self, c)
                    m *= 0.9
                    m += 0.1 * x
                    v *= 0.99
                    v += 0.01 * x * x
                    getattr(self, c)[...] += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def training_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", per_lang: int = DOCS_PER_LANG, per_doc: int = WORDS_PER_DOC) -> list[tuple[str, list[str]]]:
    """(language, words) of at most ``per_lang`` labelled documents each, by md5 of the id; of each a run of words from a hashed start."""
    rows = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("d IS NOT NULL AND l IS NOT NULL AND t IS NOT NULL")
    # ids are ranked, and texts then fetched for those chosen
    rank = F.row_number().over(Window.partitionBy("l").orderBy("m", "d"))
    ids = cut(rows.select("d", "l", F.md5("d").alias("m")).withColumn("k", rank).where(F.col("k") <= per_lang).select("d", "l", "m").distinct())
    chosen = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["d", "l"]).dropDuplicates(["d", "l"])
    words = F.filter(F.split(F.lower("t"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    start = F.lit(1) + F.pmod(F.xxhash64("m"), F.greatest(F.size("w") - per_doc, F.lit(1)))
    got = chosen.select("l", "m", words.alias("w")).where(F.size("w") > 0).select("l", "m", F.slice("w", start.cast("int"), per_doc).alias("w"))
    return [(r["l"], r["w"]) for r in sorted(got.collect(), key=lambda r: (r["l"], r["m"], r["w"]))]


def switched(data: list[tuple[str, list[str]]], langs: list[str], number: int, rng: np.random.Generator, words: int = 60) -> list[list[tuple[str, int]]]:
    """Sequences that switch between languages: runs of 3 to 25 words from one labelled document after the other."""
    by = [[w for x, w in data if x == c] for c in langs]
    out = []
    for _ in range(number):
        seq: list[tuple[str, int]] = []
        mono = rng.random() < 0.4
        c = int(rng.integers(len(langs)))
        while len(seq) < words:
            if not mono:
                c = int(rng.integers(len(langs)))
            source = by[c][int(rng.integers(len(by[c])))]
            at = int(rng.integers(len(source)))
            seq += [(w, c) for w in source[at : at + int(rng.integers(3, 26))]]
        out.append(seq)
    return out


def corpus_lexicon(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = LEXICON_WORDS) -> dict[str, str]:
    """The language of each word that is seen three times or more and at least nine times in ten in one language.

    Words are counted over all labelled documents; the ``most`` commonest of those are kept. Counts are added up within
    tasks before they are shuffled.
    """
    rows = docs.select(F.lower(F.col(text)).alias("t"), F.col(lang).cast("string").alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    words = rows.select("l", F.explode(F.split("t", r"[^\p{L}\p{N}_]+")).alias("w")).where("w <> ''")
    by = words.groupBy("w", "l").agg(F.count("*").alias("n")).groupBy("w").agg(F.sum("n").alias("n"), F.max(F.struct("n", "l")).alias("top"))
    found = by.where("n >= 3 AND top.n >= 0.9 * n").orderBy(F.desc("n"), "w").limit(most).select("w", "top.l").collect()
    return {r["w"]: r["l"] for r in found}


def train(data: list[tuple[str, list[str]]], sequences: int = SEQUENCES, seed: int = 3, lexicon: dict[str, str] | None = None) -> Crf | None:
    """A CRF fitted on code-switched sequences made of labelled documents; None without any. Without ``lexicon``, that of the same documents is used."""
    langs = sorted({c for c, _ in data})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    if lexicon is None:
        counts: dict[str, list[int]] = {}
        for c, words in data:
            for w in words:
                counts.setdefault(w, [0] * len(langs))[langs.index(c)] += 1
        # a word belongs to a lexicon if it is seen often enough and mostly in one language
        known = {w: int(np.argmax(n)) for w, n in counts.items() if sum(n) >= 3 and max(n) >= 0.9 * sum(n)}
    else:
        number = {c: k for k, c in enumerate(langs)}
        known = {w: number[c] for w, c in lexicon.items() if c in number}
    model = Crf(langs, known)
    model.fit(switched(data, langs, sequences, rng))
    return model


def label_texts(model: Crf, texts: list[str]) -> list[np.ndarray]:
    """The language number of every word of the texts."""
    words = [WORD.findall(t.lower()) for t in texts]
    lengths = np.array([len(w) for w in words])
    flat = list(chain.from_iterable(words))
    if not flat:
        return [np.empty(0, dtype=np.int64) for _ in texts]
    kinds: dict[str, int] = {}
    number = np.fromiter((kinds.setdefault(w, len(kinds)) for w in flat), dtype=np.int64, count=len(flat))
    e = model.emissions(list(kinds))[number]
    best = model.marginals(e, lengths).argmax(axis=1)
    return np.split(best, np.cumsum(lengths)[:-1])


def label_languages(
    docs: DataFrame, model: Crf | None = None, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", per_lang: int = DOCS_PER_LANG, per_doc: int = WORDS_PER_DOC, sequences: int = SEQUENCES, lexicon_words: int = LEXICON_WORDS
) -> DataFrame:
    """Label each word's language: (doc_id, n_words, main_lang, main_share, n_switches, spans).

    A linear-chain CRF with character n-gram, affix, whole-word and lexicon features and learned
    transitions gives every word of every document the language of highest marginal probability, by
    forward-backward over the whole text. ``spans`` holds (first word, words, language) of each run of one
    language. Without ``model``, one is fitted on ``sequences`` code-switched sequences of some 60 words, made of at most
    ``per_lang`` documents of each value of the language column and of a run of at most ``per_doc`` words of each.
    Its lexicon has the ``lexicon_words`` commonest words that are mostly of one language, counted over all documents that have a language.

    Words are runs of letters, digits and underscores in lower case. Null, empty or wordless text: 0 words,
    null main language and share, no spans. Ties of main language go to the first by name. Null ids and
    repeated rows are labelled each. No labelled document to learn from: words are counted, and languages
    null. Empty table: empty result. Other columns are ignored.
    """
    if model is None and (data := training_words(docs, text, doc_id, lang, per_lang, per_doc)):
        model = train(data, sequences, lexicon=corpus_lexicon(docs, text, lang, lexicon_words))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("main_lang", pa.string()), ("main_share", pa.float64()), ("n_switches", pa.int64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids = batch.column("d").to_pylist()
            for start, part in pieces(batch, "t", 4_000_000):
                mine = ids[start : start + len(part)]
                if model is None:
                    n, none = [len(WORD.findall(t.lower())) for t in part], [None] * len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((mine, n, none, none, [0] * len(part), [[]] * len(part)), schema)], schema=schema)
                    continue
                labels = label_texts(model, part)
                flat = np.concatenate(labels)
                lengths = np.array([len(y) for y in labels])
                heads = np.cumsum(lengths) - lengths
                new = np.diff(flat, prepend=-1) != 0
                new[heads[lengths > 0]] = True
                at = np.flatnonzero(new)
                size = np.diff(np.append(at, len(flat)))
                owner = np.searchsorted(np.cumsum(lengths), at, side="right")
                spans = np.bincount(owner, minlength=len(part))
                offsets = np.concatenate([[0], np.cumsum(spans)]).astype(np.int32)
                names = pa.array(model.langs, pa.string())
                items = pa.StructArray.from_arrays([pa.array(at - heads[owner]), pa.array(size), names.take(pa.array(flat[at]))], fields=list(span))
                tally = np.zeros((len(part), len(model.langs)), dtype=np.int64)
                np.add.at(tally, (owner, flat[at]), size)
                main = tally.argmax(axis=1)
                none = lengths == 0
                share = np.round(tally.max(axis=1) / np.maximum(lengths, 1), 6)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mine, pa.int64()), pa.array(lengths.astype(np.int64)), names.take(pa.array(main, mask=none)), pa.array(share, mask=none),
                        pa.array(np.maximum(spans - 1, 0).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), items),
                    ], schema=schema,
                )

    ddl = "doc_id long, n_words long, main_lang string, main_share double, n_switches long, spans array<struct<first: long, words: long, lang: string>>"
    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, ddl)
