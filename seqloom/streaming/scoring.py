"""Streaming: scoring, deduplication and windowed rates."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.model import scored


def score_stream(rows: DataFrame, model: PipelineModel, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Score each micro-batch and append it as Parquet under its batch number, so that a
    batch that is run again replaces its own files and no row is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        scored(model, batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def first_deliveries(steps: DataFrame, key: str = "step_id", time: str = "arrived_at", late: str = "7 days") -> DataFrame:
    """The stream without repeated deliveries of a key within the watermark."""
    return steps.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def abnormal_rate(scores: DataFrame, time: str = "scored_at", window: str = "1 hour", late: str = "1 day", prob: str = "prob_abnormal", threshold: float = 0.5) -> DataFrame:
    """Scored rows and alerts by tumbling window; late rows count within the watermark."""
    alert = F.col(prob).isNotNull() & ~F.isnan(prob) & (F.col(prob) >= threshold)
    return scores.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("scored"), F.count_if(alert).alias("alerts")).select(F.col("window.start").alias("start"), "scored", "alerts")
