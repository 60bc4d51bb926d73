import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions.scores import argmax, softmax, with_predictions


def scored(spark, logits):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(logits)], "i int, logits array<double>")
    return [tuple(r) for r in df.select("i", softmax(F.col("logits")).alias("p")).withColumn("k", argmax(F.col("p"))).orderBy("i").select("p", "k").collect()]


def test_ties_large_values_and_null(spark):
    tie, large, none, empty = scored(spark, [[1.0, 1.0], [1000.0, 999.0], None, []])
    assert tie == ([0.5, 0.5], 0)
    assert large[0][0] == pytest.approx(1 / (1 + math.exp(-1)), abs=1e-6) and large[1] == 0
    assert none == (None, None)
    assert empty == ([], None)


def test_nan_makes_all_nan_and_class_0(spark):
    (p, k), = scored(spark, [[float("nan"), 1.0]])
    assert all(math.isnan(x) for x in p) and k == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=1, max_size=30))
def test_probabilities_sum_to_one_and_decide_the_class(spark, values):
    for (p, k), (a, b) in zip(scored(spark, [list(v) for v in values]), values):
        assert sum(p) == pytest.approx(1, abs=1e-5)
        assert (k == 1) == (p[1] > p[0])


def test_columns_are_replaced_in_place(spark):
    df = spark.createDataFrame([("t", 9, [0.0, 1.0], "x")], "text string, pred int, logits array<double>, extra string")
    out = with_predictions(df, "logits")
    assert out.columns == ["text", "pred", "extra", "prob_abnormal"]
    assert dict(out.dtypes)["pred"] == "bigint" and dict(out.dtypes)["prob_abnormal"] == "float"
    assert out.first()["pred"] == 1
