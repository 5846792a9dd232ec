"""The pipeline's stages, one after the other, against plain Python."""

from collections import defaultdict

import corpus_pipeline as P
from helpers import SF
from test_decontaminate import brute as brute_hits
from test_lines_shards_packs import brute_lines, valid
from test_ngram_join import brute as brute_pairs

from eventide.llm import quality
from eventide.llm.common import WORD, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def brute_keep_one(rows):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, _ in brute_pairs([r[:2] for r in rows], 3, 0.5):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [r for r in rows if find(r[0]) == r[0]]


def test_stages_against_plain_python(spark):
    docs = table(spark, SF, "documents")
    stages = dict(P.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    scores = quality.quality_scores(docs, table(spark, SF, "labels")).where("keep")
    wanted = {r["doc_id"] for r in scores.collect()}
    now = stages["quality_classifier"](spark, docs, SF).cache()
    rows = plain(now)
    assert now.columns == docs.columns and rows == [r for r in plain(docs) if r[0] in wanted]
    now = stages["line_dedup"](spark, now, SF).cache()
    want = sorted(brute_lines([tuple(r) for r in rows], 0.05, 5), key=repr)
    assert [r[:2] for r in plain(now)] == [r[:2] for r in want]
    rows = plain(now)
    now = stages["ngram_jaccard_join"](spark, now, SF).cache()
    assert plain(now) == brute_keep_one(rows)
    rows = plain(now)
    now = stages["benchmark_decontamination"](spark, now, SF).cache()
    hit = {h[0] for h in brute_hits([r[:2] for r in rows], [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()])}
    assert hit and plain(now) == [r for r in rows if r[0] not in hit]
    rows = plain(now)
    packed = stages["best_fit_packing"](spark, now, SF).collect()
    valid(packed, 2048)
    lengths = defaultdict(int)
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {r[0]: len(r[1].split()) + 1 for r in rows if r[1].split()}
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, packed))


def test_stages_take_odd_rows_and_empty_tables(spark, odd_docs, plain_docs, no_docs):
    for docs in (odd_docs, plain_docs, no_docs):
        now = docs
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, now, SF)
            assert k == len(P.STAGES) - 1 or out.columns == docs.columns
            assert out.count() <= now.count() + 40
            now = out
    assert WORD.search("x")


def test_a_dense_cluster_in_the_third_stage(spark, monkeypatch):
    """A cluster is cut by its pairs, and still one of its documents stays."""
    from eventide.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CELL_PAIRS", 100)
    rows = [(k, " ".join([*(f"c{j}" for j in range(20)), f"own{k}"])) for k in range(60)] + [(500, "another text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, dict(P.STAGES)["ngram_jaccard_join"](spark, docs, SF).collect())) == [rows[0], rows[-1]]


def test_the_third_stage_in_many_slices_and_blocks(spark, monkeypatch):
    """Ranges of postings in slices, more blocks of counts than ranges, and cells of few pairs leave the same documents as brute force."""
    from eventide.llm import ngram_join

    for k, v in (("RANGE_POSTINGS", 100), ("MEET_POSTINGS", 7), ("BLOCK_RANGES", 2), ("CELL_PAIRS", 20)):
        monkeypatch.setattr(ngram_join, k, v)
    rows = []
    for c in range(6):
        rows += [(100 * c + k, " ".join([*(f"c{c}w{j}" for j in range(14)), *(f"own{k % 9}x{j}" for j in range(k % 4))])) for k in range(25)]
    rows += [(1000 + k, f"single text number {k} without a partner {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, dict(P.STAGES)["ngram_jaccard_join"](spark, docs, SF).collect())) == sorted(brute_keep_one(rows))


def test_slices_of_postings_and_places_of_groups():
    """No slice of a range of postings holds more than it may besides its last token; pairs find the slice of their group."""
    import numpy as np
    import pyarrow as pa

    from eventide.llm import ngram_join

    tok = np.sort(np.random.default_rng(2).integers(0, 3000, 20_000).astype(np.uint64))
    slices = list(ngram_join._token_slices(tok, 1000))
    assert [a for a, _ in slices] == [0, *(b for _, b in slices[:-1])] and slices[-1][1] == len(tok)
    assert all(tok[b - 1] != tok[b] for _, b in slices[:-1]) and max(b - a for a, b in slices) < 1100
    names = [(0, ngram_join._frame(np.arange(30).reshape(10, 3))), (10, ngram_join._frame(np.arange(30, 45).reshape(5, 3)))]
    assert [ngram_join._framed(b, 3) for _, b in names] == [10, 5]
    assert ngram_join._picked(names, np.array([1, 9, 10, 14], dtype=np.uint32))[:, 0].tolist() == [3, 27, 30, 42]
    g, k = np.array([-5, -5, 3, 8]), np.array([0, 2, 1, 0])
    left, right = pa.chunked_array([[8, -5, -5, -5], [3, 4, 9, -9]]), pa.chunked_array([[0, 2, 1, 3], [1, 0, 0, 0]], pa.int32())
    assert ngram_join._places(g, k, left, right).tolist() == [3, 1, 4, 4, 2, 4, 4, 4]
    assert ngram_join._places(g[:0], k[:0], left, right).tolist() == [0] * 8
