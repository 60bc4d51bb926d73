"""Softmax, argmax and prediction columns as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits as array<float>; safe for large values.
    A NaN makes all of them NaN; null stays null."""
    # array_max ranks NaN above numbers, so a NaN reaches every quotient
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: (x / total).cast("float"))


def argmax(values: Column) -> Column:
    """Index of the first maximum, from 0; null for null or empty arrays."""
    return F.nullif(F.array_position(values, F.array_max(values)), F.lit(0).cast("bigint")) - 1


def with_predictions(df: DataFrame, logits_col: str, pred: str = "pred", prob: str = "prob_abnormal") -> DataFrame:
    """``df`` without the logits, with the predicted class and the probability of class 1;
    columns of these names are replaced in place."""
    p = softmax(F.col(logits_col))
    return df.withColumns({pred: argmax(p).cast("bigint"), prob: F.get(p, F.lit(1)).cast("float")}).drop(logits_col)
