"""Problem 2: frequency of every distinct term.

Vertical layout. A partition turns its records round into one row for each term and
block of 65,536 record identifiers: the compressed bitmap of the records that hold
the term (a sorted list of 16-bit offsets, or 8 KB of bits where that is shorter) and
the number of occurrences beside it. Rows of a term and block are merged by the
bitmaps' union, and the document frequency is the union's cardinality.

Results for odd input: rows with a null text are no records, blank texts are records
without terms; an identifier that occurs twice is one record, whose occurrences add
up; rows with a null identifier are left out, since a bitmap can't hold them, unless
each row is taken as a record; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.words import codes_of, flat_words
from seqloom.plans.shared import spread

BLOCK = 1 << 16
DENSE = BLOCK // 16  # offsets from which bits are the shorter form
#: Words held before a partition's part is written out; bounds a worker's memory.
HELD_WORDS = 2_000_000


def encode(offsets: np.ndarray) -> bytes:
    """The shorter form of a set of distinct ascending 16-bit offsets."""
    if len(offsets) <= DENSE:
        return offsets.astype("<u2").tobytes()
    bits = np.zeros(BLOCK, bool)
    bits[offsets] = True
    return np.packbits(bits).tobytes() + b"\0"


def decode(blob: bytes) -> np.ndarray:
    """The offsets of a bitmap in either form."""
    if len(blob) == BLOCK // 8 + 1:
        return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, BLOCK // 8)))
    return np.frombuffer(blob, "<u2")


def union_size(blobs: list[bytes]) -> int:
    """Cardinality of the union."""
    if len(blobs) == 1:
        return len(decode(blobs[0]))
    if sum(map(len, blobs)) < 2048:
        return len(np.unique(np.concatenate([decode(x) for x in blobs])))
    bits = np.zeros(BLOCK, bool)
    for x in blobs:
        bits[decode(x)] = True
    return int(bits.sum())


def _partial(texts: list[str], ids: np.ndarray) -> pa.RecordBatch:
    """Term, block, bitmap and occurrences of a part."""
    flat, counts = flat_words(texts, ungroup=False)
    codes, distinct = codes_of(flat)
    blocks, row_block = np.unique(ids // BLOCK, return_inverse=True)
    offset = ids - blocks[row_block] * BLOCK
    group = codes * len(blocks) + np.repeat(row_block, counts)
    both, occ = np.unique(group * BLOCK + np.repeat(offset, counts), return_counts=True)
    group, offset = both // BLOCK, both % BLOCK
    starts = np.flatnonzero(np.r_[True, np.diff(group) != 0]) if len(both) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(both)]
    cards = ends - starts
    low = offset.astype("<u2")
    if len(cards) and cards.max() > DENSE:
        bitmaps = pa.array([encode(offset[a:b]) for a, b in zip(starts, ends)], pa.binary())
    else:  # the lists stand one after another as they are
        at = np.r_[starts, len(both)] * 2 if len(both) else np.zeros(1)
        bitmaps = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(low)])
    head = group[starts]
    terms = distinct.take(pa.array(head // max(len(blocks), 1)))
    sums = np.add.reduceat(occ, starts) if len(starts) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([terms, pa.array(blocks[head % len(blocks)] if len(head) else head), bitmaps, pa.array(sums), pa.array(cards)], ["term", "block", "bitmap", "occurrences", "card"])


def term_bitmaps(df: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    """(term, block, bitmap, occurrences, card): the partitions' parts, not yet merged.
    Without ``id_col`` each row is a record, under its number in the scan: for hashed or
    sparse identifiers, whose blocks would hold few records each, and null ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        ids: list[np.ndarray] = []
        chars = 0
        for b in batches:
            new = b.column(1).to_pylist()
            texts += new
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            chars += sum(map(len, new))
            if chars > HELD_WORDS * 6:
                yield _partial(texts, np.concatenate(ids))
                texts, ids, chars = [], [], 0
        if texts:
            yield _partial(texts, np.concatenate(ids))

    number = F.monotonically_increasing_id() if id_col is None else F.col(id_col).cast("long")
    rows = df.where(F.col(text_col).isNotNull()).select(number.alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return spread(rows).mapInArrow(run, "term string, block long, bitmap binary, occurrences long, card long")


def term_counts(df: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    """(term, records, occurrences): document frequency and occurrences of every term.

    A block's parts meet in one group, at most one row for each partition that holds
    records of the block, so a term in every record is spread over all blocks."""
    parts = term_bitmaps(df, id_col, text_col)
    # Runs of 1,024 blocks stay together: rows of a rare term meet in one task, those of
    # a frequent one are spread over as many tasks as there are runs.
    sorted_parts = parts.repartition("term", F.expr("block div 1024")).sortWithinPartitions("term", "block")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(b: pa.RecordBatch) -> pa.RecordBatch:
            """The terms of a piece that holds whole groups, in order."""
            code = b.column("term").dictionary_encode()
            at = np.asarray(code.indices)
            block = np.asarray(b.column("block"))
            new = np.r_[True, (np.diff(at) != 0) | (np.diff(block) != 0)]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.r_[starts, len(at)])
            size = np.asarray(b.column("card"))[starts].copy()
            for i in np.flatnonzero(sizes > 1):
                size[i] = union_size(b.column("bitmap").slice(starts[i], sizes[i]).to_pylist())
            occ = np.add.reduceat(np.asarray(b.column("occurrences")), starts)
            first = np.flatnonzero(np.r_[True, np.diff(at[starts]) != 0])
            return pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(at[starts][first])), pa.array(np.add.reduceat(size, first)), pa.array(np.add.reduceat(occ, first))], ["term", "records", "occurrences"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = (b.column("term")[b.num_rows - 1], b.column("block")[b.num_rows - 1])
            same = np.asarray(b.column("block")) == last[1].as_py()
            i = b.num_rows
            while i and same[i - 1] and b.column("term")[i - 1] == last[0]:
                i -= 1
            if i or (held and (held[-1].column("term")[0], held[-1].column("block")[0]) != last):
                whole = [*held, b.slice(0, i)]
                held = [b.slice(i)]
                table = pa.Table.from_batches(whole).combine_chunks()
                if table.num_rows:
                    yield done(table.to_batches()[0])
            else:
                held.append(b)
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return sorted_parts.mapInArrow(merge, "term string, records long, occurrences long").groupBy("term").agg(F.sum("records").alias("records"), F.sum("occurrences").alias("occurrences"))


def marked_terms(df: DataFrame, id_col: str | None, text_col: str, rare_below: int = 3, common_above: float = 0.3) -> DataFrame:
    """``term_counts`` with ``mark``: 'rare' in fewer than ``rare_below`` records,
    'common' in more than ``common_above`` of the records, else null; rows with a null
    identifier are no records, unless ``id_col`` is None and each row is one."""
    known = F.lit(True) if id_col is None else F.col(id_col).isNotNull()
    records = df.where(known & F.col(text_col).isNotNull()).count()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * records, "common")
    return term_counts(df, id_col, text_col).withColumn("mark", mark)
