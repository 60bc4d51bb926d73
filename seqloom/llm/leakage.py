"""Problem 8: evaluation texts leaking into training text.

The n-grams of the evaluation items' normalised words make a hash set, which is
broadcast if its checked number and text size allow. Training texts are scanned by a
rolling hash of their word windows; a window whose hash is in the set is verified word
by word. From the hits come the documents with the items that leaked, and the corpus
with the spans or the documents taken out.

If the set is too large to broadcast, a filter of its hashes' bits takes its place: of
at most 64 MB whatever the items, merged in a stream. Windows that pass it meet the
items' n-grams in a shuffle join of hash and words, so that they are verified, too.

Results for odd input: null, blank and short texts hold no n-gram, on either side; a
document that occurs twice is reported once; items that share a passage are all
reported; a null identifier is reported as null; other columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.words import WORD, codes_of, flat_words, hash_words, words
from seqloom.plans.shared import checked_broadcast, materialize, spread

BASE = np.uint64(0x9E3779B97F4A7C15)
#: N-grams up to which the set is broadcast (some 150 bytes each), and bytes of the
#: texts that hold them.
BROADCAST_GRAMS, BROADCAST_BYTES = 500_000, 128 << 20
TABLE_BITS = 22
#: Bits of the filter that stands for a larger set.
FILTER_BITS = range(22, 30)
PART_BITS = 16


def windows(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling hash, text and first word of every window of ``size`` words."""
    flat, counts = flat_words(texts, ungroup=False)
    codes, distinct = codes_of(flat)
    h = hash_words(distinct.to_pylist())[codes]
    n = max(len(h) - size + 1, 0)
    total = np.zeros(n, np.uint64)
    for j in range(size):  # Horner's rule modulo 2 ** 64
        total *= BASE
        total += h[j : j + n]
    # only windows inside one text
    starts = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(texts)), counts)[:n]
    first = np.arange(n) - starts[row] if n else np.zeros(0, np.int64)
    inside = first + size <= counts[row] if n else np.zeros(0, bool)
    return total[inside], row[inside], first[inside]


class Grams:
    """The hash set: hash to the (item, words) that have it."""

    def __init__(self, items: list[tuple[int, str]], size: int) -> None:
        self.size = size
        self.owners: dict[int, dict[tuple[int, str], None]] = defaultdict(dict)
        for item, text in items:
            found = words(text)
            hashes, _, first = windows([text], size)
            for h, i in zip(hashes.tolist(), first.tolist()):
                self.owners[h][item, " ".join(found[i : i + size])] = None
        self.hashes = np.array(sorted(self.owners), np.uint64)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def hits(self, texts: list[str | None]) -> dict[int, list[tuple[int, int]]]:
        """Text to the verified (first word, item) of its windows."""
        h, row, first = windows(texts, self.size)
        near = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        near = near[np.isin(h[near], self.hashes)]
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        split: dict[int, list[str]] = {}
        for r, i, value in zip(row[near].tolist(), first[near].tolist(), h[near].tolist()):
            if r not in split:
                split = {r: words(texts[r])}
            gram = " ".join(split[r][i : i + self.size])
            found[r] += [(i, item) for item, own in self.owners[value] if own == gram]
        return found


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")


def _gram_rows(rows: DataFrame, size: int, passed=None, places: bool = False, chunk: int = 50_000) -> DataFrame:
    """(id, h, gram) of the distinct windows of each text of ``rows`` (id, text), whose
    hash passes the filter if there is one. With ``places`` (t1, t2, first, h, gram) of
    every such window, the text named by its 128-bit hash."""
    names = ["t1", "t2", "first"] if places else ["id"]
    types = {"t1": pa.int64(), "t2": pa.int64(), "first": pa.int32(), "id": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = b.column("id").to_pylist()
            h, row, first = windows(texts, size)
            near = np.arange(len(h)) if passed is None else np.flatnonzero(_passes(passed.value, h))
            out: list[tuple] = []
            seen: set[tuple[int, int]] = set()
            at, split, name = -1, [], ()
            for r, i, value in zip(row[near].tolist(), first[near].tolist(), h[near].view(np.int64).tolist()):
                if r != at:
                    at, split = r, words(texts[r])
                    name = _halves(xxhash.xxh3_128_intdigest(texts[r])) if places else (ids[r],)
                    seen.clear()
                if places or (value, r) not in seen:
                    seen.add((value, r))
                    out.append((*name, *([i] if places else []), value, " ".join(split[i : i + size])))
                if len(out) >= chunk:
                    yield batch(out)
                    out = []
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * (len(names) + 2)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[types[n] for n in names], pa.int64(), pa.string()])], [*names, "h", "gram"])

    schema = "t1 long, t2 long, first int, h long, gram string" if places else "id long, h long, gram string"
    return rows.select("id", "text").mapInArrow(run, schema)


def _passes(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = (len(filled) * 8 - 1).bit_length()
    at = (h >> np.uint64(64 - bits)).astype(np.int64)
    return (filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def hash_filter(grams: DataFrame, number: int) -> np.ndarray:
    """The set bits of the column ``h``: sixteen for each of ``number`` hashes, within
    ``FILTER_BITS``. Tasks send the positions they set; a task that merges holds the
    parts it owns."""
    bits = next((b for b in FILTER_BITS if 1 << b >= 16 * number), FILTER_BITS[-1])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.asarray(b.column(0)).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            ids, starts = np.unique(at >> PART_BITS, return_index=True)
            own = np.split(at, starts[1:]) if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([(x & (1 << PART_BITS) - 1).astype(np.uint16).tobytes() for x in own], pa.binary())], ["part", "at"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(part, np.zeros(1 << PART_BITS, bool))[np.frombuffer(at, np.uint16)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["part", "bits"])

    filled = np.zeros(1 << bits - 3, np.uint8)
    step = 1 << PART_BITS - 3
    for r in grams.select("h").mapInArrow(build, "part long, at binary").repartition("part").mapInArrow(merge, "part long, bits binary").toLocalIterator():
        filled[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return filled


class Items:
    """The items' n-grams: ``shared`` as a broadcast set if they are few enough, else
    ``grams`` (item, h, gram), written, and ``passed``, the broadcast filter of their hashes."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str, size: int, most: int) -> None:
        context = items.sparkSession.sparkContext
        texts = _texts(items, id_col, text_col)
        self.grams = materialize(_gram_rows(texts, size).withColumnRenamed("id", "item"))
        number = self.grams.count()
        holders = texts.where(F.length("text") >= 2 * size - 1)  # shorter ones hold no window
        self.shared = self.passed = None
        if number <= most and (holders.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES:
            self.shared = context.broadcast(Grams([(r["id"], r["text"]) for r in holders.toLocalIterator()], size))
        else:
            self.passed = context.broadcast(hash_filter(self.grams, number))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text_col: str = "text", size: int = 10, most: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc, item): distinct documents and the items of which they hold a window."""
    own = Items(items, item_id, text_col, size, most)
    rows = spread(_texts(docs, doc_id, text_col))
    if own.shared is None:
        seen = _gram_rows(rows, size, own.passed)
        return seen.join(own.grams, ["h", "gram"]).select(F.col("id").alias("doc"), "item").distinct()
    shared = own.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list({(r, item) for r, found in shared.value.hits(b.column(1).to_pylist()).items() for _, item in found})
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r for r, _ in pairs], pa.int64())), pa.array([i for _, i in pairs], pa.int64())], ["doc", "item"])

    return rows.mapInArrow(run, "doc long, item long").distinct()


def _halves(digest: int) -> tuple[int, int]:
    return (digest >> 64) - (1 << 63), (digest & (2**64 - 1)) - (1 << 63)


def _cut(text: str, firsts: list[int], size: int) -> tuple[str, int]:
    """The text without the windows that start at these words, and how many spans that are."""
    places = [m.span() for m in WORD.finditer(text)]
    parts, at, spans = [], 0, 0
    for i in sorted(set(firsts)):
        start, end = places[i][0], places[i + size - 1][1]
        if start > at or not spans:
            parts.append(text[at:start])
            spans += 1
        at = max(at, end)
    return "".join(parts) + text[at:], spans


def _cut_by_join(rows: DataFrame, own: Items, size: int) -> DataFrame:
    """``cleaned`` by a shuffle join of n-grams: windows that pass the filter meet the
    items' n-grams, and their positions go back to their texts, which are named by their
    128-bit hash."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [None if t is None else _halves(xxhash.xxh3_128_intdigest(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([k and k[j] for k in keys], pa.int64()) for j in (0, 1))], ["id", "text", "t1", "t2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_cut(t, f, size) if f else (t, 0) for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], ["doc", "text", "spans"])

    seen = _gram_rows(rows.where("text is not null"), size, own.passed, places=True)
    firsts = materialize(seen.join(own.grams.select("h", "gram").distinct(), ["h", "gram"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("first").alias("firsts")))
    texts = rows.where("text is not null").mapInArrow(keyed, "id long, text string, t1 long, t2 long")
    met = texts.join(checked_broadcast(firsts), ["t1", "t2"], "left").select("id", "text", "firsts")
    nulls = rows.where("text is null").select("id", "text", F.lit(None).cast("array<int>").alias("firsts"))
    return met.unionByName(nulls).mapInArrow(cut, "doc long, text string, spans int")


def cleaned(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text_col: str = "text", size: int = 10, whole: bool = False, most: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc, text, spans): the corpus without leaked spans, and how many were cut out of
    each text; with ``whole``, without the documents that hold any."""
    own = Items(items, item_id, text_col, size, most)
    rows = spread(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).alias("text")))
    if own.shared is None:
        out = _cut_by_join(rows, own, size)
        return out.where("spans = 0") if whole else out
    shared = own.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            cuts = [0] * len(texts)
            for r, found in shared.value.hits(texts).items():
                if found:
                    texts[r], cuts[r] = _cut(texts[r], [i for i, _ in found], size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(cuts, pa.int32())], ["doc", "text", "spans"])

    out = rows.mapInArrow(run, "doc long, text string, spans int")
    return out.where("spans = 0") if whole else out
