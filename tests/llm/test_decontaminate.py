import math
import random
from collections import Counter

import pytest

from eventide.llm import decontaminate as D
from eventide.llm.common import WORD

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def split(t):
    return WORD.findall(t.lower())


def brute(docs, items, least=0.5, q=0.5, a=0.5):
    """All passages against all items, without an index."""
    items = [(i, t) for i, t in items if t and split(t)]
    bags = [Counter(split(t)) for _, t in items]
    df = Counter(w for b in bags for w in b)
    mean = sum(map(len, map(split, [t for _, t in items]))) / max(len(items), 1)
    m = max([len(split(t)) for _, t in items], default=1)

    def weight(b, w):
        n = sum(b.values())
        return math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * n / mean))

    out = []
    for i, text in docs:
        ws = split(text or "")
        starts = range(0, max(len(ws) - m, 1), m) if ws else ()
        for (k, t), b in zip(items, bags):
            hits = []
            for s in starts:
                p = ws[s : s + 2 * m]
                score = sum(weight(b, w) for w in b if w in p) / sum(weight(b, w) for w in b)
                have = set(zip(p, p[1:])) | {(w,) for w in p}
                sides = [D.bigrams(split(x)) for x in D.question_answer(t)]
                x, y = (len(g & have) / max(len(g), 1) for g in sides)
                if score >= least - 1e-12 and x >= q - 1e-12 and y >= a - 1e-12:
                    hits.append((score, x, y))
            if hits:
                out.append((i, k, len(hits), *(round(max(c), 6) for c in zip(*hits))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "most"), [(1, 20_000), (2, 7), (3, 20_000)])
def test_contamination_brute_force(spark, seed, most):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(60)] + ["the"] * 20
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, f"{text(rng.randint(1, 12))}. {text(rng.randint(1, 6))}") for k in range(25)] + [(25, text(9)), (26, None), (27, "..."), (None, text(5)), (3, text(8))]
    docs = []
    for k in range(60):
        body = text(rng.randint(0, 120)).split()
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split()
            if w and rng.random() < 0.5:
                w[rng.randrange(len(w))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = w
        docs.append((k, " ".join(body)))
    got = D.find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), index_items=most).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)
    left = D.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), index_items=most)
    assert sorted(map(tuple, left.collect())) == sorted(d for d in docs if d[0] not in {r["doc_id"] for r in got})


def test_classes_of_length(spark, monkeypatch):
    """Each class of items is searched as if by itself, with the statistics of all."""
    monkeypatch.setattr(D, "SHORT", 8)
    rng = random.Random(6)
    pool = [f"w{k}" for k in range(80)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, f"{text(rng.randint(2, 5))}. {text(rng.randint(1, 2))}") for k in range(12)] + [(20 + k, f"{text(rng.randint(9, 20))}? {text(4)}") for k in range(9)] + [(40, text(90))]
    docs = []
    for k in range(60):
        w = rng.choice(items)[1].split()
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "changed"
        docs.append((k, " ".join([text(rng.randint(0, 60)), *w, text(rng.randint(0, 40))])))
    groups = D.indexes(spark.createDataFrame(items, ITEMS), most=10)
    assert [[len(i.ids) for i in g] for g in groups] == [[10], [2, 8], [1, 1]] and len({i.window for g in groups for i in g}) == 3
    got = D.find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), index_items=100)
    want = []
    for low, high in ((1, 8), (9, 32), (33, 128)):
        own = [x for x in items if low <= len(split(x[1])) <= high]
        index = D.Index(own, D.Statistics([split(t) for _, t in items]))
        for d, t in docs:
            want += [(d, index.ids[j], m, round(b, 6), round(q, 6), round(r, 6)) for j, (m, b, q, r) in index.search([split(t)], 0.5, 0.5, 0.5)[0].items()]
            ws, m = split(t), index.window
            for k, (i, x) in enumerate(own):
                best = max(sum(index.impacts.flat[index.items.begin[w] + list(index.items[w]).index(k)] for w in {index.vocabulary[y] for y in set(split(x)) & set(ws[s : s + 2 * m])}) for s in range(0, max(len(ws) - m, 1), m))
                assert best >= 0.5 - 1e-9 or (d, i) not in {r[:2] for r in want}
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    left = D.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {r[0] for r in want}


def test_an_index_is_as_large_as_its_items():
    import pickle
    import random as r

    r.seed(1)
    items = [(k, " ".join(f"v{min(r.randrange(60_000), r.randrange(60_000))}" for _ in range(60))) for k in range(20_000)]
    index = D.Index(items)
    assert len(pickle.dumps(index)) < 60_000_000
    assert [index.ids[j] for j in index.search([split(items[77][1])], 0.9, 0.5, 0.5)[0]] == [77]


def test_sentences_without_words(spark):
    """Found as the SQL doesn't: there, a side without words is met by nothing."""
    items = ["Which one of the two is it? Paris is. ***", "?! Paris lies on the river Seine", "*** ... !", "One lone sentence of words. - ?"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(items)], DOCS)
    got = D.find_contamination(docs, spark.createDataFrame([(k, t) for k, t in enumerate(items)], ITEMS)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["question_overlap"], r["answer_overlap"]) for r in got) == [(k, k, 1.0, 1.0) for k in (0, 1, 3)]
    assert D.question_answer(items[0]) == ("Which one of the two is it?", "Paris is.")


@pytest.mark.parametrize("seed", range(20))
def test_wand_finds_all(seed):
    rng = random.Random(seed)
    items = [(k, " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randint(1, 15)))) for k in range(50)]
    index = D.Index(items)
    for _ in range(40):
        terms = sorted(rng.sample(range(len(index.vocabulary)), rng.randint(1, 20)))
        total = Counter()
        for w in terms:
            for i, x in zip(index.items[w], index.impacts[w]):
                total[i] += x
        least = rng.choice([0.2, 0.5, 0.9])
        assert {i for i, _ in index.wand(terms, least)} >= {i for i, x in total.items() if x >= least + 1e-9}
        assert all(abs(total[i] - x) < 1e-9 for i, x in index.wand(terms, least))


def test_contamination_odd(spark, odd_docs, odd_rows, no_docs):
    same = odd_rows[0][1]
    items = spark.createDataFrame([(1, same, None), (None, None, 2), (2, "", 3)], "item_id long, text string, d int")
    got = D.find_contamination(odd_docs, items).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted([1, 2, 2, None, 9], key=repr)
    left = D.decontaminate(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == len(odd_rows) - 5
    none = items.where("item_id = 99")
    assert D.find_contamination(odd_docs, none).collect() == [] and D.decontaminate(odd_docs, none).count() == len(odd_rows)
    assert D.find_contamination(no_docs, items).collect() == [] and D.decontaminate(no_docs, items).collect() == []
