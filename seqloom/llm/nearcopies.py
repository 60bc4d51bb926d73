"""Problem 4: near-duplicate records with small edits.

Texts with the same word set are one class. Classes are joined by prefix filtering
under several global token orders: a candidate pair meets in the inverted list of a
prefix token of the first order, from rare to frequent, and must also share a prefix
token under two orders that each put another half of all tokens first; larger sets probe
the lists of smaller ones. The other orders are checked inside the join by 64-bit masks
of the prefixes, and so are the whole sets by 128-bit maps: two sets differ in at least
as many tokens as their maps in bits. So the filters are intersected before any set is
fetched. What is left is verified on whole sets; no filter can lose a pair at or above
the threshold.

Results for odd input: null and blank texts are in no class and no pair; a null
identifier takes no part; rows with equal identifiers are one record only in the
distinct result; an empty table gives empty results; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import wordsets as W
from seqloom.llm.components import components
from seqloom.llm.words import flat_of
from seqloom.plans.shared import BROADCAST_ROWS, attach_groups, materialize, release, rows_up_to


def prefix_rows(reps: DataFrame, freq: np.ndarray, share: Fraction) -> DataFrame:
    """(key, rep, n, m1, m2, b1, b2): one row for each prefix token of the first order.
    The masks have a bit for each prefix token of the other orders, the maps one for
    each token. ``share`` is the part of a set that its partners share at least, so
    prefixes are n - ceil(share n) + 1 long."""
    table = reps.sparkSession.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, counts = flat_of(b.column("toks"), np.uint64)
            take = W.overlap_prefix(counts, share)
            starts = np.cumsum(counts) - counts
            inner = np.arange(len(flat)) - np.repeat(starts, counts)
            head = inner < np.repeat(take, counts)
            masks = []
            for order in (1, 2):
                own = flat[W.ordered(flat, counts, table.value, order)]
                bit = np.where(head, np.uint64(1) << (own * W.MIXES[2] >> np.uint64(58)), np.uint64(0))
                masks.append(np.bitwise_or.reduceat(bit, starts).view(np.int64))
            place = flat * W.MIXES[2] >> np.uint64(57)
            for half in (0, 1):
                bit = np.where(place >> np.uint64(6) == half, np.uint64(1) << (place & np.uint64(63)), np.uint64(0))
                masks.append(np.bitwise_or.reduceat(bit, starts).view(np.int64))
            keys = flat[W.ordered(flat, counts, table.value, 0)][head].view(np.int64)
            row = np.repeat(np.arange(len(counts)), take)
            rep = np.asarray(b.column("rep"))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rep[row]), pa.array(counts[row].astype(np.int32)), *[pa.array(m[row]) for m in masks]], ["key", "rep", "n", "m1", "m2", "b1", "b2"])

    return reps.select("rep", "toks").mapInArrow(run, "key long, rep long, n int, m1 long, m2 long, b1 long, b2 long")


def met(reps: DataFrame, freq: np.ndarray, threshold: Fraction, keep_all: bool = False) -> DataFrame:
    """(a, b) of the candidates: pairs that meet by the first order and pass the other
    filters: the second order, the third, the maps. With ``keep_all`` all pairs that meet,
    with (second, third, maps): what they pass.

    A similar pair shares at least t of its larger set, and at least 2 t / (1 + t) of its
    smaller one. So larger sets probe, with the longer prefixes, lists of the shorter
    prefixes of smaller sets. Sets of one length that share too little have no shared
    token in these, however frequent it is: a hot token brings together only what is
    similar."""
    t, u = threshold.numerator, threshold.denominator
    probes, lists = prefix_rows(reps, freq, threshold).alias("x"), prefix_rows(reps, freq, 2 * threshold / (1 + threshold)).alias("y")
    smaller = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.rep") < F.col("x.rep")))
    length = F.col("y.n") * u >= F.col("x.n") * t
    orders = [F.col(f"x.{m}").bitwiseAND(F.col(f"y.{m}")) != 0 for m in ("m1", "m2")]
    differ = F.bit_count(F.col("x.b1").bitwiseXOR(F.col("y.b1"))) + F.bit_count(F.col("x.b2").bitwiseXOR(F.col("y.b2")))
    # |x| + |y| - 2 |both| is at most (1 - t) / (1 + t) of |x| + |y|
    maps = differ * (u + t) <= (F.col("x.n") + F.col("y.n")) * (u - t)
    on = (F.col("x.key") == F.col("y.key")) & smaller & length
    pair = [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]
    if keep_all:
        return probes.join(lists, on).select(*pair, orders[0].alias("second"), orders[1].alias("third"), maps.alias("maps")).distinct()
    return probes.join(lists, on & orders[0] & orders[1] & maps).select(*pair).distinct()


def fetched(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with both sets. Sets of classes without a candidate stay where
    they are if the candidates' number was checked to be small."""
    sets = reps.select("rep", "toks")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    if rows_up_to(ids, BROADCAST_ROWS) <= BROADCAST_ROWS:
        sets = sets.join(F.broadcast(ids), "rep", "left_semi")
    left = sets.select(F.col("rep").alias("a"), F.col("toks").alias("toks_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("toks").alias("toks_b"))
    return pairs.join(left, "a").join(right, "b")


def verified(fetched_pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b, similarity) of the pairs whose sets reach the Jaccard threshold."""
    t, u = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("toks_a").to_pylist(), batch.column("toks_b").to_pylist()
            both = np.fromiter((W.shared(p, q) for p, q in zip(x, y)), np.int64, len(x))
            either = np.fromiter((len(p) // 8 + len(q) // 8 for p, q in zip(x, y)), np.int64, len(x)) - both
            ok = pa.array(both * u >= either * t)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both / np.maximum(either, 1))], ["a", "b", "similarity"]).filter(ok)

    return fetched_pairs.select("a", "b", "toks_a", "toks_b").mapInArrow(run, "a long, b long, similarity double")


class NearCopies:
    """Classes of equal word sets of ``df`` and the similar pairs of classes."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8) -> None:
        self.threshold = Fraction(str(threshold))
        sets = materialize(W.token_sets(df, id_col, text_col))  # the one pass over the texts
        self.keyed = materialize(sets.select("id", F.unhex(F.md5("toks")).alias("key")))
        #: (toks, rep, copies) of the classes; counted before the shuffle, so a hot class is one row a task.
        self.reps = materialize(sets.groupBy("toks").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
        release(sets)
        self.freq = W.sketch(self.reps)
        candidates = materialize(met(self.reps, self.freq, self.threshold))
        #: (a, b, similarity): similar classes by their smallest identifiers.
        self.links = materialize(verified(fetched(candidates, self.reps), self.threshold))
        release(candidates)

    def filtered(self) -> DataFrame:
        """(step, pairs): how many pairs of classes are left after each filter."""
        pairs = met(self.reps, self.freq, self.threshold, keep_all=True)
        passed = [F.lit(True), F.col("second"), F.col("second") & F.col("third"), F.col("second") & F.col("third") & F.col("maps")]
        names = ["first order", "second order", "third order", "maps"]
        counts = pairs.agg(*[F.count_if(c).alias(n) for n, c in zip(names, passed)])
        return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("step"), F.col(n).alias("pairs")) for n in names]))).unionByName(self.links.agg(F.lit("similar").alias("step"), F.count(F.lit(1)).alias("pairs")))

    def members(self) -> DataFrame:
        """(id, rep): the rows of classes of two or more."""
        total = self.reps.agg(F.sum("copies")).first()[0] or 0
        groups = materialize(self.reps.where("copies > 1").select(F.unhex(F.md5("toks")).alias("key"), "rep", "copies"))
        return attach_groups(self.keyed, groups, "key", "copies", total).select("id", "rep")

    def groups(self) -> DataFrame:
        """(id, cls, grp, links) of every row with a word: its class and group by their
        smallest identifiers, and the number of other rows it is similar to."""
        rows = self.reps.where("copies = 1").select(F.col("rep").alias("id"), F.col("rep").alias("cls")).unionByName(self.members().select("id", F.col("rep").alias("cls")))
        sizes = self.reps.select("rep", "copies")
        both = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        linked = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
        classes = sizes.join(linked.withColumnRenamed("a", "rep"), "rep", "left").join(components(self.links).select(F.col("node").alias("rep"), F.col("component")), "rep", "left")
        named = materialize(classes.select(F.col("rep").alias("cls"), "copies", F.coalesce("component", "rep").alias("grp"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links")))
        total = self.reps.agg(F.sum("copies")).first()[0] or 0
        return attach_groups(rows, named, "cls", "copies", total).select("id", "cls", "grp", "links")

    def pairs(self) -> DataFrame:
        """(id_a, id_b): all pairs of rows, copies expanded."""
        members = materialize(self.members())
        m = members.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
        n = members.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
        across = self.links.join(m, "a", "left").join(n, "b", "left").select(F.coalesce("ia", "a").alias("p"), F.coalesce("ib", "b").alias("q"))
        within = m.join(n, (F.col("a") == F.col("b")) & (F.col("ia") < F.col("ib"))).select(F.col("ia").alias("p"), F.col("ib").alias("q"))
        return across.unionByName(within).where("p <> q").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()
