"""Token ids, truncation, padding and masks.

Without a vocabulary a token's id is a hash of it, in native expressions. With a
WordPiece vocabulary, read from a folder, the pieces are looked up in an Arrow UDF.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Ids of padding, unknown, start and end tokens of the uncased vocabulary.
PAD, UNKNOWN, START, END = 0, 100, 101, 102
RESERVED = 1000


def words(text: Column) -> Column:
    """Lower-case words and single punctuation marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"), F.lit(1))


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def hashed_ids(tokens: Column, size: int = 30522) -> Column:
    """An id for each token in [RESERVED, size)."""
    return F.transform(tokens, lambda t: (F.pmod(F.xxhash64(t), F.lit(size - RESERVED)) + RESERVED).cast("int"))


def truncated(ids: Column, max_length: int = 256, start: int | str = START, end: int | str = END) -> Column:
    """At most ``max_length`` ids, or tokens, the start and end tokens included."""
    return F.concat(F.array(F.lit(start)), F.slice(ids, 1, max_length - 2), F.array(F.lit(end)))


def padded(ids: Column, length: int = 256, pad: int | str = PAD) -> Column:
    """``ids``, or tokens, filled up to ``length``; longer ones stay."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def mask(ids: Column, pad: int = PAD) -> Column:
    """1 for tokens, 0 for padding."""
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def encoded(text: Column, max_length: int = 256, pad_to: int | None = None) -> Column:
    """input_ids of a text: hashed, truncated and, with ``pad_to``, padded."""
    ids = truncated(hashed_ids(words(F.coalesce(text, F.lit("")))), max_length)
    if pad_to is None:
        return ids
    # one use of the ids, so that they are computed once; none are longer than max_length
    return F.slice(F.concat(ids, F.array_repeat(F.lit(PAD), pad_to)), 1, pad_to) if pad_to >= max_length else padded(ids, pad_to)


#: The ranges of ideographs that stand alone as words, and the ASCII
#: symbols that count as punctuation beside the Unicode class.
IDEOGRAPHS = "\u4e00-\u9fff\u3400-\u4dbf\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b820-\U0002ceaf\uf900-\ufaff\U0002f800-\U0002fa1f"
SYMBOLS = "$+<=>^`|~"


_ASCII_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+")
_ASCII_WORD = re.compile(r"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+")


@lru_cache(1)
def _basic() -> tuple[re.Pattern, re.Pattern]:
    """Patterns of a basic word and of what is dropped before."""
    kind = {c: unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)}
    marks = "".join(re.escape(chr(c)) for c, k in kind.items() if k[0] == "P" or chr(c) in SYMBOLS)
    gone = [c for c, k in kind.items() if k == "Mn" or k[0] == "C" and chr(c) not in "\t\n\r"]
    spans: list[list[int]] = []
    for c in gone:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    dropped = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return re.compile(f"[{IDEOGRAPHS}]|[{marks}]|[^\\s{IDEOGRAPHS}{marks}]+"), re.compile(f"[{dropped}]+")


def basic_words(text: str | None) -> list[str]:
    """Lower-case words without accents and control characters; every punctuation mark
    (the underscore, too) and every ideograph is a word of its own."""
    text = (text or "").lower()
    if text.isascii():
        return _ASCII_WORD.findall(_ASCII_CONTROL.sub("", text))
    word, dropped = _basic()
    return word.findall(dropped.sub("", unicodedata.normalize("NFD", text)))


def basic_tokens(text: Column) -> Column:
    """``basic_words`` of a column, by an Arrow UDF."""
    return F.pandas_udf(lambda texts: texts.map(basic_words), "array<string>")(text)


def load_vocabulary(spark: SparkSession, folder: str) -> dict[str, int]:
    """Token to id of ``folder``/vocab.txt, one token a line in the order of the ids."""
    lines = spark.read.text(f"{folder.rstrip('/')}/vocab.txt", wholetext=True).first()
    if lines is None:
        raise ValueError(f"empty vocabulary in {folder}")
    return {token: i for i, token in enumerate(lines[0].rstrip("\n").split("\n"))}


def save_vocabulary(spark: SparkSession, vocabulary: dict[str, int], folder: str) -> None:
    """The inverse of ``load_vocabulary``; ids without a token get a reserved name."""
    names = {i: t for t, i in vocabulary.items()}
    lines = [names.get(i, f"[unused{i}]") for i in range(max(names, default=-1) + 1)]
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/vocab.txt")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray("\n".join(lines) + "\n", "utf-8"))
    finally:
        out.close()


def pieces_of(word: str, vocabulary: dict[str, int]) -> list[int]:
    """Greedy longest-match ids of a word; one unknown id if some part has no match."""
    ids, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = word[at:end] if at == 0 else "##" + word[at:end]
            if piece in vocabulary:
                ids.append(vocabulary[piece])
                break
        else:
            return [vocabulary.get("[UNK]", UNKNOWN)]
        at = end
    return ids


def wordpiece(spark: SparkSession, vocabulary: dict[str, int], max_length: int = 256, longest: int = 100, pad: str | None = None):
    """A pandas UDF text → input_ids of at most ``max_length``; words of more than
    ``longest`` characters are unknown. ``pad``: None for none, ``max_length``, or
    ``longest`` for the longest text of the Arrow batch, as a model's call needs it."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        unknown, start, end, fill = (known.get(t, i) for t, i in (("[UNK]", UNKNOWN), ("[CLS]", START), ("[SEP]", END), ("[PAD]", PAD)))
        kept: dict[str, list[int]] = {}
        for texts in batches:
            rows = []
            for text in texts:
                ids: list[int] = []
                for w in basic_words(text):
                    if w not in kept:
                        if len(kept) > 200_000:
                            kept.clear()
                        kept[w] = pieces_of(w, known) if len(w) <= longest else [unknown]
                    ids += kept[w]
                    if len(ids) >= max_length - 2:
                        break
                rows.append([start, *ids[: max_length - 2], end])
            width = {None: 0, "max_length": max_length, "longest": max(map(len, rows), default=0)}[pad]
            yield pd.Series([r + [fill] * (width - len(r)) for r in rows])

    return encode
