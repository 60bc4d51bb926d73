"""Problem 7: encoding of the whole corpus with a public byte-level BPE tokenizer.

A text is split by the tokenizer's public pattern. In each piece, a segment tree over
the byte positions holds the lowest merge rank of a pair of neighbours and, among
equals, the leftmost; a merge changes at most three leaves, each a logarithmic walk to
the root, so a piece of n bytes takes O(n log n) whatever it repeats. Pieces met
before come from a bounded table.

Results for odd input: null and empty texts have an empty list; strings that look like
special tokens are ordinary text; rows with equal or null identifiers are encoded like
any others; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.shared import spread

#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = 1 << 62
#: Pieces and their lengths that a worker keeps.
KEPT, KEPT_CHARS = 400_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is also the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Byte-level BPE by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.find = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(data)
        if n == 1:
            return [self.ranks[data]]
        get, longest = self.ranks.get, self.longest
        size = 1 << (n - 1).bit_length()
        # a leaf is rank * n + position, so the minimum is the leftmost of the lowest
        # rank; `after` and `before` link the live positions, `after` of the last is n
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            rank = get(data[i : i + 2])
            if rank is not None:
                tree[size + i] = rank * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(position: int, value: int) -> None:
            i = size + position
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                if other < value:
                    value = other
                i >>= 1
                if tree[i] == value:
                    return
                tree[i] = value

        def pair(position: int) -> int:
            """The leaf of a live position with its right neighbour."""
            middle = after[position]
            if middle >= n or after[middle] - position > longest:
                return NONE
            rank = get(data[position : after[middle]])
            return NONE if rank is None else rank * n + position

        while tree[1] != NONE:
            left = tree[1] % n
            gone = after[left]
            after[left] = end = after[gone]
            if end < n:
                before[end] = left
            put(gone, NONE)
            put(left, pair(left))
            if before[left] >= 0:
                put(before[left], pair(before[left]))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text."""
        if not text:
            return []
        kept, ids = self.kept, []
        for p in self.find(text):
            found = kept.get(p)
            if found is None:
                found = self.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[p] = found
            ids += found
        return ids


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every row. The driver reads the vocabulary file, whose size is fixed
    by the tokenizer, and broadcasts it; no shuffle is needed."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            lists = [np.array(encoder.encode(t), np.int32) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["id", "ids"])

    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, "id long, ids array<int>")
