from pyspark.sql import functions as F

from seqloom.plans import shared
from seqloom.plans.shared import attach_groups, checked_broadcast, materialize, release, shared_dir, spread


def test_materialize_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, b"x", None), (2, None, [1])], "a long, b binary, c array<int>")
    back = materialize(df)
    assert back.dtypes == df.dtypes and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert shared_dir(spark) == shared_dir(spark)


def test_hot_and_cold_groups_join_alike(spark, rows):
    members = spark.range(1000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("k"), "id")
    groups = members.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    want = rows(members.join(groups, "k").select("id", "rep"))
    for least in (1, 100, 10**9):
        assert rows(attach_groups(members, groups, "k", "n", 1000, least=least).select("id", "rep")) == want


def test_broadcast_is_only_hinted_within_the_bound(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    big = spark.range(1000).withColumnRenamed("id", "k")
    plan = lambda side: big.hint("shuffle_merge").join(side, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(checked_broadcast(small, 10)) and "broadcast" not in plan(checked_broadcast(small, 9))


def test_materialize_by_a_column(spark, rows):
    df = spark.range(20).select("id", (F.col("id") % 3).cast("int").alias("part"))
    back = materialize(df, by="part")
    assert rows(back.where("part = 1")) == rows(df.where("part = 1")) and sorted(back.columns) == sorted(df.columns)


def test_only_small_inputs_are_spread(spark, monkeypatch):
    df = spark.range(100).coalesce(1)
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(shared, "SPREAD_BYTES", 10)
    assert spread(df).rdd.getNumPartitions() == 1


def test_release_deletes_the_table(spark):
    from pathlib import Path

    table = materialize(spark.range(3))
    path = Path(table._written.removeprefix("file:"))
    assert table.count() == 3 and path.exists()
    release(table)
    assert not path.exists()
