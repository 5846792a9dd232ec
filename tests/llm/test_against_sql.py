"""Operators that SQL can express, on the small tables."""

import pytest
from helpers import SF, rows_of, rows_of_sql

from eventide.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert rows_of(llm.queries()[name](spark, SF)) == rows_of_sql(llm.oracle_sql()[name])


def test_all_operators_are_registered():
    names = llm.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for p in (root / "eventide").rglob("*.py"):
        if "llm" not in p.parts:
            assert "eventide.llm" not in p.read_text(), p
