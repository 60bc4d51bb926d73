"""Problem 1: duplicates hidden by formatting differences.

Every record gets a canonical form and its 128-bit hash. Each partition sets the
hashes' bits in two Bloom filters, one of hashes seen once and one of hashes seen
more than once. Merging partitions, a bit that two partitions have both seen becomes
a bit of the second filter, so that filter holds every repeated hash. Only records
that test positive are shuffled and grouped exactly; all others are singletons.

The filter grows with the rows, twelve bits for each. What a worker holds does not: the
hashes are written by range, as many ranges as keep each one's filter within a bound,
and the ranges are filtered one after another.

Results for odd input: blank and null texts are never copies, each is its own record;
equal ids of repeated rows are members like any others; a null id counts as a copy
but can't be a representative unless all ids of the group are null; an empty table
gives an empty result. Only the id and text columns are read, whatever others exist.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.words import flat_of
from seqloom.plans.shared import attach_groups, materialize, spread

#: The ops and keys of the transfer notation.
OPS = frozenset("lock deposit parse authorize unlock src relay auth dst gas retry note check".split())
KEYS = frozenset("tx to amount ts id nonce fee memo ref_lock ref_deposit ref_parse ref_auth src_tx price limit used attempt".split())

#: Format and control characters, which no reader sees, and variation selectors.
_HIDDEN = {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf" or 0xFE00 <= c <= 0xFE0F}
_GROUP = re.compile("(?<=\\d)[,'\u2019\u00a0\u2009\u202f](?=\\d{3}(?!\\d))")
#: A word, or a number with its decimal point.
_TOKEN = re.compile(r"\w+(?:(?<=\d)\.(?=\d)\w+)*")


def canonical(text: str | None) -> str | None:
    """The steps in order, each with its op and its sorted fields; None if blank.

    Case, white space, invisible characters and punctuation are gone, but for the
    decimal point; a key's value is all that follows up to the next key or op."""
    if not text:
        return None
    if not text.isascii():
        text = text.translate(_HIDDEN)
    steps: list[str] = []
    step = ""
    fields: list[str] = []
    field = ""
    found = _TOKEN.findall(_GROUP.sub("", text.casefold()))
    if not found:
        return None
    for token in found:
        if token in OPS:
            if field:
                fields.append(field)
            if step or fields:
                fields.sort()
                steps.append(step + "\x1f" + "\x1f".join(fields))
            step, fields, field = token, [], ""
        elif token in KEYS:
            if field:
                fields.append(field)
            field = token + "="
        else:
            field = field + " " + token if field else token
    if field:
        fields.append(field)
    fields.sort()
    steps.append(step + "\x1f" + "\x1f".join(fields))
    return "\x1e".join(steps)


def canonical_keys(df: DataFrame, id_col: str, text_col: str, form=canonical) -> DataFrame:
    """(id, key): the 128-bit hash of the canonical form, null for blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            forms = [form(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if f is None else digest(f) for f in forms], pa.binary())], ["id", "key"])

    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, "id long, key binary")


SEGMENT_BITS = 1 << 16
PROBES = 2
#: Bits of the filter for each row: of a row without copies each bit is met by another
#: row with a chance of 1 - exp(-2 / 12), so some 2.4 % of such rows are shuffled.
BITS = 12
#: Bound of one range's filter, in bytes.
FILTER_BYTES = 64 << 20


def _positions(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and the PROBES bit positions in it, of keys given as rows of two uint64."""
    seg = (keys[:, 0] >> np.uint64(20)) % np.uint64(segments)
    bits = np.stack([(keys[:, 1] >> np.uint64(16 * i)) & np.uint64(0xFFFF) for i in range(PROBES)], 1)
    return seg.astype(np.int64), bits.astype(np.int64)


def _packed(seg: np.ndarray, bits: np.ndarray) -> dict[int, np.ndarray]:
    """Distinct set bits by segment."""
    flat = np.unique((seg[:, None] * SEGMENT_BITS + bits).ravel())
    at = flat // SEGMENT_BITS
    cut = np.flatnonzero(np.diff(at)) + 1
    return {int(part[0] // SEGMENT_BITS): (part % SEGMENT_BITS).astype(np.uint16) for part in np.split(flat, cut)} if len(flat) else {}


def repeat_filter(keyed: DataFrame, rows: int, bits_a_row: int = BITS, max_bytes: int = FILTER_BYTES, chunk_rows: int = 2_000_000) -> tuple[int, dict[int, bytes]]:
    """The merged filter of possibly repeated keys: number of segments, and the bits of
    each segment that has any.

    A partition sends only the positions it has set, two bytes each, so what is
    shuffled follows the rows, not partitions times filter size. Segments are merged in
    a stream: a task holds those it owns, however many partitions sent them."""
    segments = 1
    while segments * SEGMENT_BITS < rows * bits_a_row and segments * SEGMENT_BITS // 8 < max_bytes:
        segments *= 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(parts), axis=0, return_counts=True) if len(parts) else (np.zeros((0, 2), np.uint64), np.zeros(0))
            seg, bits = _positions(keys, segments)
            seen, again = _packed(seg, bits), _packed(seg[n > 1], bits[n > 1])
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([v.tobytes() for v in seen.values()], pa.binary()), pa.array([again[s].tobytes() if s in again else b"" for s in seen], pa.binary())], ["seg", "seen", "again"])

        parts: list[np.ndarray] = []
        held = 0
        for b in batches:
            column = b.column(0).drop_null()
            if len(column):
                parts.append(flat_of(column, np.uint64)[0].reshape(-1, 2))
                held += len(column)
            if held >= chunk_rows:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    def packed(positions: bytes) -> np.ndarray:
        bits = np.zeros(SEGMENT_BITS, bool)
        bits[np.frombuffer(positions, np.uint16)] = True
        return np.packbits(bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for seg, seen, again in zip(*(c.to_pylist() for c in b.columns)):
                once, twice = held.setdefault(seg, (np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)))
                new = packed(seen)
                twice |= once & new
                once |= new
                if again:
                    twice |= packed(again)
        found = {seg: twice for seg, (_, twice) in held.items() if twice.any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["seg", "bits"])

    partial = keyed.select("key").where("key is not null").mapInArrow(build, "seg long, seen binary, again binary")
    merged = partial.repartition("seg").mapInArrow(merge, "seg long, bits binary")
    return segments, {r["seg"]: bytes(r["bits"]) for r in merged.toLocalIterator()}  # max_bytes in all


def possible_repeats(keyed: DataFrame, segments: int, filled: dict[int, bytes]) -> DataFrame:
    """``keyed`` with ``maybe``: whether the key may occur more than once."""
    at = {s: i + 1 for i, s in enumerate(sorted(filled))}
    slots = np.zeros(segments, np.int32)
    for s, i in at.items():
        slots[s] = i
    table = np.zeros((len(at) + 1, SEGMENT_BITS // 8), np.uint8)
    for s, i in at.items():
        table[i] = np.frombuffer(filled[s], np.uint8)
    shared = keyed.sparkSession.sparkContext.broadcast((slots, table))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, table = shared.value
        for b in batches:
            key = b.column("key")
            ok = np.asarray(key.is_valid())
            maybe = np.zeros(b.num_rows, bool)
            if ok.any():
                seg, bits = _positions(flat_of(key.drop_null(), np.uint64)[0].reshape(-1, 2), segments)
                at = slots[seg]
                hit = np.ones(len(seg), bool)
                for i in range(PROBES):
                    hit &= (table[at, bits[:, i] >> 3] >> (7 - (bits[:, i] & 7)).astype(np.uint8)) & 1 == 1
                maybe[ok] = hit
            yield pa.RecordBatch.from_arrays([b.column("id"), key, pa.array(maybe)], ["id", "key", "maybe"])

    return keyed.select("id", "key").mapInArrow(probe, "id long, key binary, maybe boolean")


class Copies:
    """Groups of copies of the records of ``df``."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, form=canonical, max_bytes: int = FILTER_BYTES) -> None:
        self.rows = df.count()
        ranges = max(1, -(-self.rows * BITS // (8 * max_bytes)))
        keyed = canonical_keys(df, id_col, text_col, form)
        if ranges == 1:
            self.keyed = materialize(keyed)
            self.probed = possible_repeats(self.keyed, *repeat_filter(self.keyed, self.rows, max_bytes=max_bytes))
        else:
            self.keyed = materialize(keyed.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int")), by="range")
            parts = []
            for i in range(ranges):
                own = self.keyed.where(F.col("range") == i).select("id", "key")
                parts.append(materialize(possible_repeats(own, *repeat_filter(own, -(-self.rows // ranges), max_bytes=max_bytes))))
            self.probed = reduce(DataFrame.unionByName, parts)
        maybe = self.probed.where("maybe").select("id", "key")
        self.groups = maybe.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        self.maybe = maybe

    def records(self) -> DataFrame:
        """(id, copies): one row for each distinct record, with its smallest id."""
        single = self.probed.where("not maybe").select("id", F.lit(1).cast("long").alias("copies"))
        return single.unionByName(self.groups.select(F.col("rep").alias("id"), "copies"))

    def members(self) -> DataFrame:
        """(id, rep, copies): all members of groups of two or more."""
        groups = materialize(self.groups.where("copies > 1"))
        return attach_groups(self.maybe, groups, "key", "copies", self.rows).select("id", "rep", "copies")

    def pairs(self) -> DataFrame:
        """(id_a, id_b): the smallest id of each group with each other member."""
        return self.members().where("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b")).distinct()
