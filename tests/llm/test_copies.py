import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from seqloom.llm.copies import BITS, Copies, canonical, canonical_keys, possible_repeats, repeat_filter

A = "LOCK tx=0xAb to=Réné amount=85000; UNLOCK tx=0x2 to=Réné amount=85000.5"


@pytest.mark.parametrize(
    "other",
    [
        A.lower(), A.upper(), A.replace("; ", " | "), A.replace("=", ": "), A.replace("85000", "85,000"), A.replace("85000", "85'000"), "* " + A + ".", A.replace(" ", "　"), A.replace(";", ";​\n"), A.replace("LOCK tx", "LO​CK­ tx", 1),
        "LOCK(amount=85000, to='Réné', tx=`0xAb`); UNLOCK(to=“Réné”, amount=85'000.5, tx=0x2)", "LOCK tx 0xAb to Réné amount 85000 UNLOCK tx 0x2 to Réné amount 85000.5", "﻿" + A,
    ],
)
def test_notations_of_one_record(other):
    assert canonical(other) == canonical(A)


@pytest.mark.parametrize(
    "other",
    [
        A.replace("85000.5", "850005"), A.replace("0x2", "0x3"), "UNLOCK tx=0x2 to=Réné amount=85000.5; LOCK tx=0xAb to=Réné amount=85000", A + "; CHECK id=1", A.replace("tx=0x2 to=Réné", "tx=Réné to=0x2"),
        A.replace("LOCK", "SRC", 1), A.replace("amount=85000;", ";"),
    ],
)
def test_other_records(other):
    assert canonical(other) != canonical(A)


def test_blank():
    assert canonical(None) is canonical("") is canonical(" .;​") is None


def brute(data):
    groups = {}
    for i, t in data:
        if canonical(t) is not None and i is not None:
            groups.setdefault(canonical(t), []).append(i)
    return sorted((min(g), i) for g in groups.values() for i in set(g) if i != min(g))


def test_against_brute_force_with_a_hot_group(spark):
    pick = random.Random(1)
    data = [(i, f"LOCK tx={pick.randrange(150)} to=a" if i % 3 else "hot copy") for i in range(900)] + [(1000, None), (1001, ""), (1002, "?!"), (None, "hot copy"), (7, "again seven"), (7, "again seven"), (1003, "x" * 200_000), (1004, "X" * 200_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "seq_id long, text string, key string, rep int").repartition(5)
    copies = Copies(df, "seq_id", "text")
    assert sorted(map(tuple, copies.pairs().collect())) == brute(data)
    records = copies.records()
    assert records.agg({"copies": "sum"}).first()[0] == len(data)
    assert records.where("copies > 300").count() == 1


def test_filter_has_no_false_negative(spark):
    pick = random.Random(2)
    texts = [f"t{pick.randrange(400)}" for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(7)
    keyed = canonical_keys(df, "id", "text")
    repeated = {i for i, t in enumerate(texts) if texts.count(t) > 1}
    for size in (1 << 20, 8):  # a filter far too small only lets more through
        probed = possible_repeats(keyed, *repeat_filter(keyed, 1000, max_bytes=size, chunk_rows=100))
        assert repeated <= {r.id for r in probed.where("maybe").collect()}
    assert np.mean([r.maybe for r in possible_repeats(keyed, *repeat_filter(keyed, 1000)).collect()]) < len(repeated) / 1000 + 0.05


def test_empty_table(spark):
    copies = Copies(spark.createDataFrame([], "seq_id long, text string"), "seq_id", "text")
    assert copies.pairs().count() == 0 and copies.records().count() == 0


def test_ranges_of_hashes_give_the_same_groups(spark):
    pick = random.Random(5)
    data = [(i, f"LOCK tx={pick.randrange(30_000)} to=a" if i % 3 else "hot copy") for i in range(60_000)] + [(None, "hot copy"), (70_000, None), (70_001, "?")]
    df = spark.createDataFrame(data, "seq_id long, text string").repartition(5)
    copies = Copies(df, "seq_id", "text", max_bytes=1 << 14)
    assert copies.keyed.select("range").distinct().count() == 6
    assert sorted(map(tuple, copies.pairs().collect())) == brute(data)
    assert copies.records().agg({"copies": "sum"}).first()[0] == len(data)


def test_share_of_possible_repeats_at_a_load_of_billions(spark):
    """A billion distinct rows are 23 ranges of 64 MB, 12 bits a row; a segment of 5,461
    rows has the same load."""
    n = 65_536 // BITS
    keyed = spark.range(4 * n).select("id", F.unhex(F.md5(F.col("id").cast("string"))).alias("key")).repartition(6)
    share = possible_repeats(keyed, *repeat_filter(keyed, 4 * n)).agg(F.avg(F.col("maybe").cast("int"))).first()[0]
    assert share < 0.03
