"""Word sets of a corpus, their frequency sketch and prefixes under token orders.

Used by the similarity joins of problems 4 and 6. A text becomes its set of 64-bit
word hashes. Any total order of tokens is right for prefix filtering as long as it
is a function of the token alone. A token's place follows from its frequency in a count
sketch of fixed size, which is the only thing that is broadcast, and from its class, a
half of all tokens by a bit of the hash: order 0 goes from rare to frequent, order 1
puts the first class in front of the second, order 2 the second in front of the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.words import binary_rows, flat_of, word_sets
from seqloom.plans.shared import spread

#: Counters of the sketch (4 MB), whatever the corpus.
SLOTS = 1 << 20
#: Multipliers of the hash mixes that make one token order differ from another.
MIXES = (np.uint64(1), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def token_sets(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, toks, *more) of the rows whose text has a word; ``toks`` holds the distinct
    hashes ascending, so that equal sets are equal values."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more).where("id is not null and text is not null")
    names = [f.name for f in rows.schema.fields if f.name != "text"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, counts = word_sets(b.column("text").to_pylist())
            keep = pa.array(counts > 0)
            sets = binary_rows(flat, counts[counts > 0])
            yield pa.RecordBatch.from_arrays([sets, *[b.column(n).filter(keep) for n in names]], ["toks", *names])

    return spread(rows).mapInArrow(run, "toks binary, " + ", ".join(f"`{n}` {types[n]}" for n in names))


PART = 1 << 12


def slot_table(sets: DataFrame, column: str, dtype: str, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None], join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A table of ``SLOTS`` numbers over all sets: ``add`` enters a batch's tokens and set
    sizes into a task's table, ``join`` puts two tables together.

    Tasks send the slots they have met, in parts of ``PART`` slots. The parts are joined
    in a stream, so a task holds the parts it owns, however many tasks sent them; what
    reaches the driver is ``SLOTS`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(SLOTS, dtype), False
        for b in batches:
            if b.num_rows:
                add(total, *flat_of(b.column(0), np.uint64))
                met = True
        if met:
            at = np.flatnonzero(total)
            ids, starts = np.unique(at // PART, return_index=True)
            own = np.split(at, starts[1:])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([(x % PART).astype("<u2").tobytes() for x in own], pa.binary()), pa.array([total[x].tobytes() for x in own], pa.binary())], ["part", "at", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for part, at, n in zip(*(c.to_pylist() for c in b.columns)):
                own = parts.setdefault(part, np.zeros(PART, dtype))
                i = np.frombuffer(at, "<u2")
                own[i] = join(own[i], np.frombuffer(n, dtype))
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], ["part", "n"])

    merged = sets.select(column).mapInArrow(count, "part long, at binary, n binary").repartition("part").mapInArrow(merge, "part long, n binary")
    table = np.zeros(SLOTS, dtype)
    for r in merged.collect():  # SLOTS numbers
        table[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["n"], dtype)
    return table


def slots_of(flat: np.ndarray) -> np.ndarray:
    return (flat & np.uint64(SLOTS - 1)).astype(np.int64)


def sketch(sets: DataFrame, column: str = "toks") -> np.ndarray:
    """Number of sets that hold a token of each slot, over all sets."""

    def add(total: np.ndarray, flat: np.ndarray, _: np.ndarray) -> None:
        total += np.bincount(slots_of(flat), minlength=SLOTS).astype(np.uint32)

    return slot_table(sets, column, "<u4", add, lambda x, y: np.minimum(x.astype(np.int64) + y, 2**32 - 1).astype("<u4"))


def ordered(flat: np.ndarray, counts: np.ndarray, freq: np.ndarray, order: int) -> np.ndarray:
    """Indexes into ``flat`` that sort each row by a token order.

    The frequency counts by its logarithm; ties stand by a mix of the hash that differs
    from order to order. The sort is stable over hashes in ascending order, so tokens
    that tie in all else still stand in one order everywhere."""
    row = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    rank = (np.log2(freq[slots_of(flat)].astype(np.float64) + 1) * 3).astype(np.uint64)
    mixed = flat * MIXES[order]
    if order:
        half = (flat * MIXES[1] >> np.uint64(63)) ^ np.uint64(order - 1)
        rank |= half << np.uint64(7)
    return np.argsort((row << np.uint64(40)) | (rank << np.uint64(32)) | (mixed >> np.uint64(32)), kind="stable")


def overlap_prefix(counts: np.ndarray, share: Fraction) -> np.ndarray:
    """Prefix length of sets that share at least ``share`` of themselves with a partner:
    two sets that do have a common token in these prefixes under any common order."""
    t, u = share.numerator, share.denominator
    return counts - -(-counts * t // u) + 1


def shared(a: bytes, b: bytes) -> int:
    """Number of tokens in both sets."""
    return len(set(np.frombuffer(a, np.uint64).tolist()).intersection(np.frombuffer(b, np.uint64).tolist()))
