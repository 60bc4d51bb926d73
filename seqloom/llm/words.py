"""Words of a text and 64-bit word sets, in Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

#: A word is a longest run of letters, digits and underscores of any script.
WORD = re.compile(r"\w+")
#: A comma or apostrophe between a digit and exactly three digits.
DIGIT_GROUP = re.compile(r"(?<=\d)[,'](?=\d{3}(?!\d))")


def words(text: str | None) -> list[str]:
    """Words in lower case, in order; none for a null text."""
    return [w.lower() for w in WORD.findall(text)] if text else []


def flat_words(texts: list[str | None], ungroup: bool) -> tuple[list[str], np.ndarray]:
    """All words of a batch in one list, and the number of words of each text."""
    flat: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            if ungroup and ("," in text or "'" in text):
                text = DIGIT_GROUP.sub("", text)
            found = WORD.findall(text.lower() if text.isascii() else text)
            if not text.isascii():
                found = [w.lower() for w in found]
            counts[i] = len(found)
            flat += found
    return flat, counts


def codes_of(flat: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Integer code of every word, and the distinct words by code."""
    coded = pa.array(flat, pa.string()).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def hash_words(found: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def word_sets(texts: list[str | None], ungroup: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The set of word hashes of each text: a flat array in which each text's hashes
    are distinct and ascending, and the size of each set."""
    flat: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    find = WORD.findall
    for i, text in enumerate(texts):
        if text:
            if ungroup and ("," in text or "'" in text):
                text = DIGIT_GROUP.sub("", text)
            found = set(find(text.lower())) if text.isascii() else {w.lower() for w in find(text)}
            counts[i] = len(found)
            flat += found
    hashes = hash_words(flat)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    bits = max(1, (len(texts) - 1).bit_length())
    # one sort by row and the upper bits of the hash; two keys only where those tie
    key = (row << np.uint64(64 - bits)) | (hashes >> np.uint64(bits))
    order = np.argsort(key)
    if (np.diff(key[order]) == 0).any():
        order = np.lexsort((hashes, row))
    return hashes[order], counts


def binary_rows(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value for each row out of a flat array."""
    width = flat.dtype.itemsize
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * width, out=ends[1:])
    if ends[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def flat_of(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``binary_rows`` for a column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    width = np.dtype(dtype).itemsize
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype, (ends[-1] - ends[0]) // width, ends[0]) if data is not None and ends[-1] > ends[0] else np.zeros(0, dtype)
    return flat, np.diff(ends) // width
