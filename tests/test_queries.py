import os

import pytest

import __spark_entry__
from seqloom.queries import QUERIES, SQL
from tests.oracle import FOLDER, same

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_import_the_training_data_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "seqloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "seqloom.llm" not in p.read_text(), p
