import os

import pytest

from seqloom.llm.queries import QUERIES, SQL
from tests.oracle import FOLDER, same

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


COLUMNS = {
    "p1_found": [("id_a", "bigint"), ("id_b", "bigint")],
    "p2_found": [("term", "string"), ("mark", "string")],
    "p3_found": [("plan_id", "bigint"), ("source", "string"), ("label", "bigint")],
    "p4_found": [("id_a", "bigint"), ("id_b", "bigint")],
    "p6_found": [("id_a", "bigint"), ("id_b", "bigint")],
    "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p9_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_fixed_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.dtypes == COLUMNS[name]
    assert df.count() == df.distinct().count()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - set(COLUMNS)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
