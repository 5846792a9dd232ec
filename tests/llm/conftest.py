import random

import pytest

#: Columns that operators name things by, as extra columns of the input.
EXTRA = "h string, t string, x int, d string, g long, s long, ids string, block int, home int, n int, bad string, dropped_id int, repeated_id int, dedup_host int, dedup_bad int, dedup_kept int, y int, part int, keep string, score double, pack_id int, shard int, w int, length int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
N_EXTRA = EXTRA.count(",") + 1


def words(rng, n, vocabulary=None):
    pool = vocabulary or [f"{a}{b}{c}" for a in ("ba", "ko", "lu", "mi", "ne", "po") for b in ("ra", "ti", "so", "du") for c in ("n", "x", "l", "m")]
    return [rng.choice(pool) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000))
    same = " ".join(words(rng, 40))
    rows = [
        (1, same, "en", "a", len(same)), (2, same, "en", "a", None), (2, same, "en", "a", None), (3, None, "en", "a", 0), (4, "", "fr", "b", 0), (5, "  \n \n", None, "b", 5),
        (None, same + " tail", "en", None, 9), (None, None, None, None, None), (6, long, "de", "b", len(long)), (7, long + " end", "de", "b", 1), (8, "one", "en", None, 3),
        (9, "\n".join(["menu", same, "menu"]), "en", "a", 9), (10, "\u0000퟿\U0001f600 \t", "en", "a", 3), (11, "!!! ...", "en", "b", 7),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """Those rows with extra columns of clashing names."""
    return spark.createDataFrame([(*r, *[None] * N_EXTRA) for r in odd_rows], f"{DOCS}, {EXTRA}")


@pytest.fixture(scope="session")
def plain_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
