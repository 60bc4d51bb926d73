"""Shared plan pieces: written intermediates, checked broadcasts, hot-group joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after its rows were counted up to this bound.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or a
    temporary one that is set here only where the session has none (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_FOLDERS: set[str] = set()


def _delete(jvm, conf, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM may be gone already  # noqa: BLE001
        pass


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return the table; with
    ``by``, in a folder for each value of that column, so that a value is read alone.

    This cuts the lineage: a lost executor costs at most the tasks that read the
    table again, and later passes read columns, not recomputed rows. The table is
    deleted when the driver ends, or by ``release``."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/seqloom-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def release(table: DataFrame) -> None:
    """Delete a table of ``materialize`` before the driver ends, once all that was
    computed from it is written."""
    spark = table.sparkSession
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), table._written)


#: Estimated bytes up to which an input may be spread by a shuffle.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its source has fewer partitions than half of them, as a
    single small file has. Inputs of more than ``SPREAD_BYTES`` stay as they are, whatever
    the cluster: their partitions are as large as the reader makes them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    small = int(str(plan.optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES
    return df.repartition(cores) if small and 2 * plan.toRdd().getNumPartitions() < cores else df


def rows_up_to(df: DataFrame, limit: int) -> int:
    """Number of rows, counted no further than ``limit + 1``."""
    return df.limit(limit + 1).count()


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is:
    the join is then a shuffle join, whose skewed partitions AQE splits."""
    return F.broadcast(df) if rows_up_to(df, limit) <= limit else df


def attach_groups(members: DataFrame, groups: DataFrame, key: str, size: str, total: int, hot_share: float = 1 / 2000, least: int = 100_000) -> DataFrame:
    """Inner join of ``members`` with ``groups`` (unique ``key``, ``size`` = members in
    the group) that no hot group can skew.

    A group is hot from ``max(least, total * hot_share)`` members on, so at most
    ``1 / hot_share`` groups are hot whatever the data; these few are broadcast and
    their members never move. The others are joined by shuffle."""
    hot_rows = max(least, int(total * hot_share))
    if total < hot_rows:
        return members.join(groups, key)
    hot = groups.where(F.col(size) >= hot_rows)
    cold = groups.where(F.col(size) < hot_rows)
    hot_keys = hot.select(key)
    return members.join(F.broadcast(hot), key).unionByName(members.join(F.broadcast(hot_keys), key, "left_anti").join(cold, key))
