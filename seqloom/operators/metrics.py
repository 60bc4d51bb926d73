"""Binary-class metrics, epoch selection and early stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """accuracy, precision, recall and f1 of class 1, with tp, fp, fn and support, over
    all rows or by group; one pass with partial aggregation.

    Rows with a null label or prediction don't count. A ratio over nothing is 0; so is
    the accuracy of no rows."""
    rows = df.where(F.col(label).isNotNull() & F.col(pred).isNotNull())
    hit = lambda want, got: F.count_if((F.col(label) == want) & (F.col(pred) == got))
    counts = [hit(1, 1).alias("tp"), F.count_if((F.col(label) != 1) & (F.col(pred) == 1)).alias("fp"), F.count_if((F.col(label) == 1) & (F.col(pred) != 1)).alias("fn"), F.count_if(F.col(label) == F.col(pred)).alias("correct"), F.count(F.lit(1)).alias("support")]
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)).select(
        *by, "tp", "fp", "fn", "support", ratio(F.col("correct"), F.col("support")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def bad_scores(df: DataFrame, prob: str = "prob_abnormal", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, null scores and NaN scores; a NaN would otherwise pass as the normal class."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col(prob).isNull()).alias("null_scores"), F.count_if(F.isnan(prob)).alias("nan_scores"))


def early_stopping(history: DataFrame, patience: int = 2, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """``history`` (epoch, f1) with ``last_best`` and ``stop``: whether ``patience`` epochs
    went by without a strict gain. A null f1 never gains. Windows are by run, whose
    epochs are few."""
    w = Window.partitionBy(*by).orderBy("epoch")
    best = F.max("f1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gained = F.col("f1").isNotNull() & (best.isNull() | (F.col("f1") > best))
    last = F.max(F.when(F.col("gained"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.min("epoch").over(Window.partitionBy(*by))
    return history.withColumn("gained", gained).withColumn("last_best", last).withColumn("stop", F.col("epoch") - F.coalesce("last_best", first - 1) >= patience).drop("gained")


def best_epochs(history: DataFrame, by: tuple[str, ...] = ("run_id",), patience: int | None = None) -> DataFrame:
    """The epoch of the highest f1 of each run, the earliest among equals; with
    ``patience``, among the epochs up to the first stop."""
    rows = history
    if patience is not None:
        marked = early_stopping(history, patience, by)
        stop = F.min(F.when(F.col("stop"), F.col("epoch"))).over(Window.partitionBy(*by))
        rows = marked.withColumn("until", stop).where("until is null or epoch <= until")
    return rows.where("f1 is not null").groupBy(*by).agg(F.max_by("epoch", F.struct("f1", -F.col("epoch"))).alias("epoch"), F.max("f1").alias("f1"))
