from datetime import datetime

from seqloom.operators.model import fit, scored
from seqloom.streaming.scoring import abnormal_rate, first_deliveries, score_stream


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    df = spark.createDataFrame([(f"row {i} {'bad' if i % 3 == 0 else 'good'}", int(i % 3 == 0)) for i in range(40)], "text string, label long")
    model, _ = fit(df, df, epochs=1, features=64)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(score_stream(rows, model, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scored(model, df).collect()))


def test_repeated_deliveries_and_rates(spark, tmp_path):
    at = datetime(2024, 1, 1, 10, 5)
    spark.createDataFrame([(1, at), (1, at), (2, at), (None, at)], "step_id long, arrived_at timestamp_ntz").write.parquet(str(tmp_path / "s"))
    steps = spark.readStream.schema("step_id long, arrived_at timestamp_ntz").parquet(str(tmp_path / "s"))
    run(first_deliveries(steps).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).format("memory").queryName("first").start())
    assert spark.table("first").count() == 3
    spark.createDataFrame([(0.9, at), (0.1, at), (float("nan"), at), (None, at), (0.9, datetime(2024, 1, 5))], "prob_abnormal float, scored_at timestamp_ntz").write.parquet(str(tmp_path / "p"))
    scores = spark.readStream.schema("prob_abnormal float, scored_at timestamp_ntz").parquet(str(tmp_path / "p"))
    run(abnormal_rate(scores).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).format("memory").queryName("rate").start())
    assert [tuple(r) for r in spark.table("rate").collect()] == [(datetime(2024, 1, 1, 10), 4, 1)]
