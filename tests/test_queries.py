import pytest
from helpers import SF, rows_of, rows_of_sql

from eventide.plans import queries as core

QUERIES, SQL = core.queries(), core.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(SQL[name])


def test_entry_imports_and_names():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_subpackage(tmp_path):
    """The repository must import and serve its queries with eventide.llm and the pipeline gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "eventide", tmp_path / "eventide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_entry_with_what_a_deleted_subpackage_leaves(tmp_path):
    """Compiled files keep a folder alive, which Python then takes for a package."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "eventide", tmp_path / "eventide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "eventide" / "llm" / "__pycache__").mkdir(parents=True)
    (tmp_path / "eventide" / "llm" / "__pycache__" / "queries.cpython-313.pyc").write_bytes(b"x")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
