import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from seqloom.llm.terms import DENSE, decode, encode, marked_terms, term_counts, union_size
from seqloom.llm.words import words


@pytest.mark.parametrize("n", [0, 1, DENSE, DENSE + 1, 65536])
def test_bitmap_round_trip(n):
    offsets = np.sort(np.random.default_rng(0).choice(65536, n, replace=False))
    assert decode(encode(offsets)).tolist() == offsets.tolist()
    assert len(encode(offsets)) <= 8193


def test_union(spark):
    pick = np.random.default_rng(1)
    for sizes in ((3, 5), (5000, 10), (9000, 9000), (1,)):
        sets = [np.sort(pick.choice(65536, n, replace=False)) for n in sizes]
        assert union_size([encode(s) for s in sets]) == len(set(np.concatenate(sets).tolist()))


def brute(data):
    records, occurrences = defaultdict(set), Counter()
    for i, t in data:
        if t is not None and i is not None:
            for w in words(t):
                records[w].add(i)
                occurrences[w] += 1
    return sorted((w, len(r), occurrences[w]) for w, r in records.items())


def test_against_brute_force(spark, rows):
    pick = random.Random(0)
    data = [(pick.randrange(-(2**40), 2**40) if i % 2 else i, " ".join(f"W{int(pick.paretovariate(0.5)) % 300}" for _ in range(pick.randrange(12)))) for i in range(2000)]
    data += [(5, "same id twice"), (5, "same id twice"), (None, "no id"), (9, None), (10, ""), (11, "long " * 60_000), (2**62, "É é É"), (-1, "negative same")]
    df = spark.createDataFrame([(*r, "x") for r in data], "seq_id long, text string, term string").repartition(6)
    assert rows(term_counts(df, "seq_id", "text")) == brute(data)


def test_dense_blocks(spark, rows):
    df = spark.range(20_000).selectExpr("id", "if(id % 2 = 0, 'all even', 'all') text").repartition(3)
    assert rows(term_counts(df, "id", "text")) == [("all", 20000, 20000), ("even", 10000, 10000)]


def test_marks_count_blank_records(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a b", "a b", "a", "", " ", None, "c", "d d", "d"])], "id long, text string")
    got = {r.term: r.mark for r in marked_terms(df, "id", "text").collect()}
    assert got == {"a": "common", "b": "common", "c": "rare", "d": "rare"}  # 9 records


def test_empty_table(spark):
    assert marked_terms(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


def test_rows_as_records_keep_blocks_dense(spark):
    """Sparse identifiers put each record into a block of its own, row numbers don't."""
    from seqloom.llm.terms import term_bitmaps

    data = [(None if i % 10 == 0 else i * 1_000_003, f"a b{i % 7}") for i in range(500)] + [(5, None)]
    df = spark.createDataFrame(data, "seq_id long, text string").coalesce(2)
    assert term_bitmaps(df, None, "text").count() <= 4 * 8 < term_bitmaps(df, "seq_id", "text").count()
    got = {r.term: (r.records, r.occurrences, r["mark"]) for r in marked_terms(df, None, "text").collect()}
    assert got["a"] == (500, 500, "common") and got["b0"] == (72, 72, None)
    assert marked_terms(df, "seq_id", "text").where("term = 'a'").first().records == 450
