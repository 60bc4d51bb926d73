import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm.bpe import PATTERN, VOCABULARY, Encoder, encode_corpus, read_ranks

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_ranks(VOCABULARY))


@pytest.fixture(scope="module")
def library(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def slow(data, ranks):
    """Merges by scanning all pairs."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_like_the_library(encoder, library, text):
    text = text.encode("utf-8", "ignore").decode("utf-8", "ignore")
    assert encoder.encode(text) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_pieces_of_any_bytes_like_a_scan(encoder, data):
    assert encoder.piece(data) == slow(data, encoder.ranks)


def test_every_token_is_itself(encoder):
    pick = random.Random(0).sample(sorted(encoder.ranks.items()), 3000)
    assert all(encoder.piece(k) == [v] for k, v in pick)


def test_long_pieces(encoder, library):
    for text in ("a" * 20_000, "ab" * 5_000, " " * 9_999 + "x", "é" * 3_000, "0x" + "f3a9" * 2_000):
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_bounded_table_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr("seqloom.llm.bpe.KEPT", 3)
    small = Encoder(encoder.ranks)
    text = "one two three four one two three four " * 5
    assert small.encode(text) == encoder.encode(text) and len(small.kept) <= 3


def test_table(spark, encoder, library):
    data = [(1, "Hello <|endoftext|> world"), (2, ""), (3, None), (4, " \n"), (5, "日本語 ﷽ \U0001f600"), (5, "again"), (None, "no id")]
    df = spark.createDataFrame([(*r, [9]) for r in data], "doc_id long, text string, ids array<int>").repartition(3)
    got = sorted(((r.id, r.ids) for r in encode_corpus(df, "doc_id", "text").collect()), key=str)
    assert got == sorted(((i, library.encode_ordinary(t) if t else []) for i, t in data), key=str)
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
