"""Problem 6: same or near-same records across splits.

A weighted cosine join between the evaluation and the training split. Each text is a
unit vector of term weights. Its terms are indexed from rare to frequent until what
remains can't reach the threshold any more: the residual's norm, or the sum of its
weights times the other split's maximum weight of each term, is below it. Of a pair,
the vector with the larger maximum weight is listed and the other probes; knowing that
no weight of a probe exceeds its own maximum, the listed one indexes fewer terms, so
that a frequent term brings together only what may be similar. Records meet in
inverted lists of indexed terms; the partial dot product, with the residual
norm as bound on the rest, prunes a pair before its vectors are fetched and the exact
dot product is computed.

With weights of 1 a Jaccard similarity of at least t implies a cosine of at least
2t / (1 + t), so at that threshold the join holds all pairs of word sets that reach t
and the exact set check that follows drops the others.

Results for odd input: null and blank texts, null identifiers and rows of no or
another split take no part; copies are joined once and expanded only in ``pairs``; an
empty split gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm import wordsets as W
from seqloom.llm.nearcopies import fetched
from seqloom.llm.words import flat_of
from seqloom.plans.shared import attach_groups, materialize, release

EPS = 1e-9


def _weights(flat: np.ndarray, freq: np.ndarray, total: int, scheme: str) -> np.ndarray:
    """Weight of each token: 1, or the inverse frequency of its sketch slot."""
    if scheme == "binary":
        return np.ones(len(flat))
    return np.log1p(total / np.maximum(freq[(flat & np.uint64(W.SLOTS - 1)).astype(np.int64)], 1))


def _unit(flat: np.ndarray, counts: np.ndarray, freq: np.ndarray, total: int, scheme: str) -> np.ndarray:
    w = _weights(flat, freq, total, scheme)
    starts = np.cumsum(counts) - counts
    return w / np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), counts)


def max_weights(reps: DataFrame, side: int, freq: np.ndarray, total: int, scheme: str) -> np.ndarray:
    """Largest weight of a token of each slot in the vectors of a side: an upper bound
    for every token of the slot."""
    shared = reps.sparkSession.sparkContext.broadcast(freq)

    def add(top: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        # rounded up, so that the bound holds in 32 bits
        np.maximum.at(top, W.slots_of(flat), np.nextafter(_unit(flat, counts, shared.value, total, scheme).astype(np.float32), np.float32(2)))

    return W.slot_table(reps.where(F.col("side").bitwiseAND(side) != 0), "toks", "<f4", add, np.maximum)


def inverted_lists(reps: DataFrame, side: int, freq: np.ndarray, other_max: np.ndarray, total: int, threshold: float, scheme: str, listed: bool) -> DataFrame:
    """(key, rep, w, rest, top): the indexed terms of a side's vectors, their weights, the
    norm of what isn't indexed, and the vector's maximum weight. ``listed``: for partners
    of no larger maximum weight."""
    shared = reps.sparkSession.sparkContext.broadcast((freq, other_max))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, other = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            flat, counts = flat_of(b.column("toks"), np.uint64)
            at = W.ordered(flat, counts, freq, 0)
            weight = _unit(flat, counts, freq, total, scheme)[at]
            flat = flat[at]
            starts = np.cumsum(counts) - counts

            def rest_from(x: np.ndarray) -> np.ndarray:
                """Sum of x from each place to the end of its row."""
                run = np.cumsum(x)
                before = np.r_[0, run[:-1]]
                return np.repeat(run[starts + counts - 1], counts) - before

            norm = np.sqrt(np.maximum(rest_from(weight * weight), 0))
            top = np.maximum.reduceat(weight, starts)
            most = other[(flat & np.uint64(W.SLOTS - 1)).astype(np.int64)]
            reach = rest_from(weight * (np.minimum(most, np.repeat(top, counts)) if listed else most))
            # a term is indexed while what stands from it on could still reach the threshold
            keep = np.minimum(norm, reach) >= threshold - 1e-6  # weights are compared in 32 bits
            row = np.repeat(np.arange(len(counts)), counts)
            indexed = np.add.reduceat(keep.astype(np.int64), starts)
            rest = np.where(indexed < counts, norm[np.minimum(starts + indexed, len(norm) - 1)], 0)
            rep = np.asarray(b.column("rep"))
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep].view(np.int64)), pa.array(rep[row[keep]]), pa.array(weight[keep].astype(np.float32)), pa.array(rest[row[keep]].astype(np.float32)), pa.array(top[row[keep]].astype(np.float32))], ["key", "rep", "w", "rest", "top"])

    own = reps.where(F.col("side").bitwiseAND(side) != 0).select("rep", "toks")
    return own.mapInArrow(run, "key long, rep long, w float, rest float, top float")


class CrossSplit:
    """Pairs of word-set classes between split sides: 1 training, 2 evaluation."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, side, threshold: float, scheme: str = "binary", jaccard: float | None = None) -> None:
        """``side``: a column, 1 for training rows, 2 for evaluation rows, else null.
        With ``jaccard`` (binary weights only) the cosine threshold is the one that it
        implies, and only pairs that reach it are kept."""
        if jaccard is not None:
            if scheme != "binary":
                raise ValueError("a Jaccard bound needs binary weights")
            threshold = 2 * jaccard / (1 + jaccard)
        rows = df.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), side.cast("int").alias("side")).where("side is not null")
        sets = materialize(W.token_sets(rows, "id_", "text_", "side"))  # the one pass over the texts
        key = F.unhex(F.md5("toks"))
        self.keyed = materialize(sets.select("id", "side", key.alias("key")))
        self.reps = materialize(sets.groupBy("toks").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.expr("bit_or(side)").alias("side")).withColumn("key", key))
        release(sets)
        self.total = self.reps.count()
        freq = W.sketch(self.reps)
        best = {s: max_weights(self.reps, s, freq, self.total, scheme) for s in (1, 2)}

        def lists(side: int, listed: bool, names: str) -> DataFrame:
            return inverted_lists(self.reps, side, freq, best[3 - side], self.total, threshold, scheme, listed).toDF("key", *names.split())

        # equal maximum weights meet with the training side listed
        met = lists(1, True, "a wa ra ta").join(lists(2, False, "b wb rb tb"), "key").where("a <> b and ta >= tb")
        met = met.unionByName(lists(1, False, "a wa ra ta").join(lists(2, True, "b wb rb tb"), "key").where("a <> b and ta < tb"))
        met = met.groupBy("a", "b").agg(
            F.sum(F.col("wa").cast("double") * F.col("wb")).alias("dot"), F.max("ra").alias("ra"), F.max("rb").alias("rb"), F.sum(F.col("wa").cast("double") * F.col("wa")).alias("na"), F.sum(F.col("wb").cast("double") * F.col("wb")).alias("nb")
        )
        # terms outside both prefixes lie in one residual; the other vector has no more
        # left there than the norm its shared terms haven't used
        left = F.greatest(F.col("ra") * F.sqrt(F.greatest(1 - F.col("nb"), F.lit(0.0))), F.col("rb") * F.sqrt(F.greatest(1 - F.col("na"), F.lit(0.0))))
        candidates = materialize(met.where(F.col("dot") + left >= threshold - 1e-4).select("a", "b"))
        self.links = materialize(self._exact(fetched(candidates, self.reps), freq, threshold, scheme, jaccard))
        release(candidates)

    def _exact(self, pairs: DataFrame, freq: np.ndarray, threshold: float, scheme: str, jaccard: float | None) -> DataFrame:
        shared = pairs.sparkSession.sparkContext.broadcast(freq)
        total = self.total
        bound = None if jaccard is None else Fraction(str(jaccard))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cosine, keep = [], []
                for p, q in zip(batch.column("toks_a").to_pylist(), batch.column("toks_b").to_pylist()):
                    x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                    if scheme == "binary":
                        both = W.shared(p, q)
                        dot = both / (len(x) * len(y)) ** 0.5
                    else:
                        both = np.intersect1d(x, y, assume_unique=True)
                        square = lambda t: float((_weights(t, shared.value, total, scheme) ** 2).sum())
                        dot = square(both) / (square(x) * square(y)) ** 0.5
                        both = len(both)
                    cosine.append(dot)
                    keep.append(dot >= threshold - EPS if bound is None else both * bound.denominator >= (len(x) + len(y) - both) * bound.numerator)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(cosine, pa.float64())], ["a", "b", "cosine"]).filter(pa.array(keep, pa.bool_()))

        return pairs.select("a", "b", "toks_a", "toks_b").mapInArrow(run, "a long, b long, cosine double")

    def members(self) -> DataFrame:
        """(id, side, rep) of the rows in classes that have a link, or rows on both sides."""
        linked = self.links.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        classes = self.reps.select("key", "rep", "copies", "side")
        wanted = classes.join(linked, "rep", "left_semi").unionByName(classes.where("side = 3").join(linked, "rep", "left_anti")).drop("side")
        groups = materialize(wanted)
        total = groups.agg(F.sum("copies")).first()[0] or 0
        return attach_groups(self.keyed, groups, "key", "copies", total).select("id", "side", "rep")

    def overlaps(self) -> DataFrame:
        """(train, held): all pairs of a training and an evaluation row, copies expanded."""
        members = materialize(self.members())
        train = members.where("side = 1").select(F.col("rep").alias("a"), F.col("id").alias("train"))
        held = members.where("side = 2").select(F.col("rep").alias("b"), F.col("id").alias("held"))
        across = self.links.join(train, "a").join(held, "b").select("train", "held")
        within = train.join(held, F.col("a") == F.col("b")).select("train", "held")
        return across.unionByName(within).distinct()


def split_side(split) -> Column:
    """1 for the training split, 2 for validation and test."""
    return F.when(split == "train", 1).when(split.isin("validation", "test"), 2)


def found_pairs(overlaps: DataFrame) -> DataFrame:
    """(id_a, id_b) with the smaller identifier first."""
    return overlaps.where("train <> held").select(F.least("train", "held").alias("id_a"), F.greatest("train", "held").alias("id_b")).distinct()


def report(cross: CrossSplit, rows: DataFrame, id_col: str) -> DataFrame:
    """(split, source, pairs, held_rows, same_label): overlaps by evaluation split and
    source, the evaluation rows concerned, and the pairs whose labels agree (null labels
    don't). Counted by class, so copies are never paired one by one."""
    about = rows.select(F.col(id_col).cast("long").alias("id"), "split", "source", "label")
    members = materialize(cross.members().join(about, "id"))
    train = members.where("side = 1").groupBy(F.col("rep").alias("a"), F.col("label").alias("train_label")).agg(F.count(F.lit(1)).alias("n"))
    held = members.where("side = 2").groupBy(F.col("rep").alias("b"), "split", "source", "label").agg(F.count(F.lit(1)).alias("m"))
    within = held.select(F.col("b").alias("a"), "b").distinct()
    met = cross.links.select("a", "b").unionByName(within).join(train, "a").groupBy("b", "train_label").agg(F.sum("n").alias("n"))
    by_label = met.groupBy("b").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.when(F.col("train_label").isNotNull(), F.struct("train_label", "n")))).alias("by_label"))
    same = F.when(F.col("label").isNotNull(), F.coalesce(F.try_element_at("by_label", "label"), F.lit(0))).otherwise(0)
    return held.join(by_label, "b").groupBy("split", "source").agg(F.sum(F.col("m") * F.col("n")).alias("pairs"), F.sum("m").alias("held_rows"), F.sum(F.col("m") * same).alias("same_label"))
