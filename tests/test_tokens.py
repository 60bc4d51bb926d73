import pytest
from pyspark.sql import functions as F

from seqloom.functions.tokens import basic_words, encoded, load_vocabulary, mask, padded, save_vocabulary, truncated, whitespace_words, wordpiece, words
from seqloom.sources.csvfiles import read_csv


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 20])
def test_truncation_padding_and_mask(spark, n):
    ids = truncated(F.array_repeat(F.lit(7), n), 8)
    got = one(spark, padded(ids, 8), x=1)
    assert got == [101, *[7] * min(n, 6), 102, *[0] * (6 - min(n, 6))]
    assert one(spark, mask(padded(ids, 8)), x=1) == [1] * (min(n, 6) + 2) + [0] * (6 - min(n, 6))


def test_words(spark):
    assert one(spark, words(F.col("t")), t="LOCK tx=0xA; é_1!") == ["lock", "tx", "=", "0xa", ";", "é_1", "!"]
    assert one(spark, whitespace_words(F.col("t")), t="  a  b ") == ["a", "b"]


def test_encoding_is_stable_and_null_is_empty(spark):
    df = spark.createDataFrame([("a b a",), (None,), ("x " * 5000,)], "t string")
    a, none, long = [r[0] for r in df.select(encoded(F.col("t"), 16, 16)).collect()]
    assert a[1] == a[3] != a[2] and len(a) == len(none) == len(long) == 16
    assert none == [101, 102, *[0] * 14] and all(1000 <= x < 30522 for x in long[1:15])


def test_wordpiece(spark):
    vocabulary = {"[UNK]": 100, "un": 5, "##lock": 6, "cafe": 7, "=": 8}
    df = spark.createDataFrame([("Unlock=CAFÉ zzz",), (None,)], "t string")
    got = [r[0] for r in df.select(wordpiece(spark, vocabulary)("t")).collect()]
    assert got == [[101, 5, 6, 8, 7, 100, 102], [101, 102]]
    for pad, width in (("longest", 7), ("max_length", 12)):
        rows = [r[0] for r in df.coalesce(1).select(wordpiece(spark, vocabulary, 12, pad=pad)("t")).collect()]
        assert [len(r) for r in rows] == [width, width] and rows[1][:2] == [101, 102]


def test_basic_words():
    assert basic_words("ref_lock=0xAb; É\u0301l\u200b\x07an 日本x ¿Qué? a\tb\u3000c €5 $6") == ["ref", "_", "lock", "=", "0xab", ";", "elan", "日", "本", "x", "¿", "que", "?", "a", "b", "c", "€5", "$", "6"]
    assert basic_words(None) == basic_words("") == basic_words(" \n") == []


PIECES = [*"lock deposit parse auth ##orize un ##lock src relay dst gas tx to amount ref id ts price limit used _ = ; alice bob carol mall ##ory eve zoe dave".split(), *"abcdefghijklmnopqrstuvwxyz0123456789", *["##" + c for c in "abcdefghijklmnopqrstuvwxyz0123456789"]]


def test_wordpiece_of_the_seven_rows(spark, tmp_path):
    """Each id is checked against the rule spelled out on its token."""
    vocabulary = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, **{t: i + 4 for i, t in enumerate(dict.fromkeys(PIECES))}}
    save_vocabulary(spark, vocabulary, str(tmp_path))
    known = load_vocabulary(spark, str(tmp_path))
    assert known == vocabulary
    name = {i: t for t, i in known.items()}
    rows = read_csv(spark, "tests/fixtures/train.csv").unionByName(read_csv(spark, "tests/fixtures/val.csv"))
    got = rows.select("text", wordpiece(spark, known)("text").alias("ids")).collect()
    assert len(got) == 7
    for r in got:
        pieces = [name[i] for i in r.ids]
        assert pieces[0] == "[CLS]" and pieces[-1] == "[SEP]" and "[UNK]" not in pieces
        assert "".join(p.removeprefix("##") for p in pieces[1:-1]) == "".join(r.text.lower().split())
        assert pieces.count("_") == r.text.count("_") and pieces.count("ref") == r.text.count("ref_")
    first = [name[i] for r in got if r.text.startswith("LOCK tx=0xA ") for i in r.ids]
    assert first[1:20] == ["lock", "tx", "=", "0", "##x", "##a", "to", "=", "alice", "amount", "=", "1", "##0", "##0", ";", "deposit", "tx", "=", "0"]
