"""Problem 3: a sample that matches target category proportions.

Acceptance probabilities follow from wanted-to-supplied ratios, with slight
oversampling; each row is accepted on its own, by a hash of plan and row identifier.
The accepted counts are then corrected exactly to the wanted ones, and categories
that the supply can't meet are reported.

Results for odd input: null source, label or split is a category of its own and
matches a null in the plan; rows with equal identifiers are accepted together and cut
like any others; rows with a null identifier are accepted one by one; null share, minimum or sample size count as 0; empty tables give empty results.
A category listed twice in a plan counts with its larger share and minimum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.shared import checked_broadcast, materialize

CATEGORY = ["split", "source", "label"]
#: Bits of the hash by which the cut is located in one step.
LEVEL_BITS = 10


def _wanted() -> Column:
    share = F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("sample_rows", F.lit(0))).cast("long")
    return F.greatest(share, F.coalesce("min_rows", F.lit(0)).cast("long"))


def _join(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join on ``columns``, where null meets null; they appear once, from ``a``."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    rest = [F.col(f"b.{c}") for c in b.columns if c not in columns]
    return a.alias("a").join(b.alias("b"), same, how).select("a.*", *rest)


def supply(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Each category of ``targets`` with ``wanted``, ``have`` and ``deficit``."""
    plans = targets.groupBy("plan_id", *CATEGORY).agg(F.max(_wanted()).alias("wanted"))
    have = rows.groupBy(*CATEGORY).agg(F.count(F.lit(1)).alias("have"))
    joined = _join(plans, have, CATEGORY, "left")
    return joined.withColumn("have", F.coalesce("have", F.lit(0))).withColumn("deficit", F.greatest(F.col("wanted") - F.col("have"), F.lit(0)))


def unmet(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, source, label, wanted, have, deficit) of the categories short of rows."""
    return supply(rows, targets).where("deficit > 0").drop("split")


def _accepted(rows: DataFrame, plans: DataFrame, id_col: str, seed: int, chance: Column, more: Column) -> DataFrame:
    """(k, id, h, v), written once: the rows whose hash lies below ``chance`` and that pass
    ``more``, in one scan. ``h`` is the hash as 62 bits; ``v`` tells equal identifiers
    apart, and null ones, whose hash is drawn from it."""
    slim = rows.select(F.col(id_col).cast("long").alias("id"), *CATEGORY).withColumn("v", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id(), F.lit(seed)))
    drawn = F.xxhash64("plan_id", F.coalesce("id", "v"), F.lit(seed))
    met = _join(slim, plans, CATEGORY).withColumn("h", F.shiftrightunsigned(drawn, 2))
    return materialize(met.where((F.col("h") < chance * F.lit(2.0**62)) & more).select("k", "id", "h", "v"))


def _digit(level: int) -> Column:
    """The ``level``-th group of ten bits of the order: those of ``h``, then those of ``v``."""
    at = level * LEVEL_BITS
    return (F.shiftrightunsigned("h", 62 - LEVEL_BITS - at) if at + LEVEL_BITS <= 60 else F.shiftrightunsigned("v", at - 60)).bitwiseAND((1 << LEVEL_BITS) - 1)


def sample(rows: DataFrame, targets: DataFrame, id_col: str, seed: int = 7, over: float = 1.05, edge_rows: int = 100_000) -> DataFrame:
    """(plan_id, id, split, source, label) of the sampled rows: of each category the
    smaller of ``wanted`` and ``have``.

    Two scans: one counts the categories, one accepts rows, and only the accepted are
    written. The cut is located among them without a sort of a category: rows are counted
    by the first bits of their hash, the rows of the cut's cell by the next bits, until
    a cell has at most ``edge_rows`` rows, which are ranked. If too few rows of a
    category were accepted (rarely), a third scan brings the rest of that category."""
    want = F.least("wanted", "have")
    # accept a few standard deviations more than wanted, so that a second draw is rare
    chance = F.least(F.lit(1.0), (want * over + 4 * F.sqrt(want.cast("double")) + 4) / F.greatest("have", F.lit(1)))
    plans = supply(rows, targets).where("wanted > 0 and have > 0").select("plan_id", *CATEGORY, want.alias("want"), chance.alias("chance"))
    plans = checked_broadcast(materialize(plans.withColumn("k", F.monotonically_increasing_id())))
    accepted = _accepted(rows, plans, id_col, seed, F.col("chance"), F.lit(True))
    counts = materialize(plans.join(accepted.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    short = counts.where("n < want")
    if not short.isEmpty():
        rest = _accepted(rows, checked_broadcast(short), id_col, seed, F.lit(1.0), F.col("h") >= F.col("chance") * F.lit(2.0**62))
        accepted = accepted.unionByName(rest)

    wanted = checked_broadcast(plans.select("k", F.col("want").alias("left")))
    open_, taken = accepted.join(wanted, "k"), []
    for level in range(12):
        at = open_.withColumn("digit", _digit(level))
        by = Window.partitionBy("k")
        cells = at.groupBy("k", "digit", "left").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(by.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        cut = materialize(cells.where("before < left and before + n >= left").select("k", F.col("digit").alias("cut"), (F.col("left") - F.col("before")).alias("left"), "n"))
        most = cut.where("n > left").agg(F.max("n")).first()[0]
        # whole cells up to the cut, the cut's own where it is wanted whole
        met = at.drop("left").join(checked_broadcast(cut), "k")
        taken.append(met.where("digit < cut or digit = cut and n = left").select("k", "id"))
        open_ = met.where("digit = cut and n > left").select("k", "id", "h", "v", "left")
        if most is None or most <= edge_rows:
            break
    rank = F.row_number().over(Window.partitionBy("k").orderBy("h", "v"))
    taken.append(open_.withColumn("rank", rank).where("rank <= left").select("k", "id"))
    return reduce(DataFrame.unionByName, taken).join(plans, "k").select("plan_id", "id", *CATEGORY)
