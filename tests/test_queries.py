"""Every registered query of the engine against its SQL."""

import pytest

from sylvan import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    oracle(queries.QUERIES[name](spark, DIR), queries.ORACLE_SQL[name])


def test_entry_imports_and_flagship(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_entry_without_the_training_data_folders(tmp_path):
    """A copy without them still imports, in a process of its own, and has every query of the engine and no other."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top / "sylvan", tmp_path / "sylvan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(top / name, tmp_path / name)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.ORACLE_SQL))], said.stderr
