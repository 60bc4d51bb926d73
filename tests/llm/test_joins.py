import random
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F

from seqloom.llm import wordsets as W
from seqloom.llm.crosssplit import CrossSplit, found_pairs, inverted_lists, max_weights, report, split_side
from seqloom.llm.nearcopies import NearCopies, prefix_rows
from seqloom.llm.words import DIGIT_GROUP, words


def word_set(text):
    return frozenset(words(DIGIT_GROUP.sub("", text))) if text else frozenset()


def similar(a, b):
    x, y = word_set(a), word_set(b)
    return bool(x and y) and 10 * len(x & y) >= 8 * len(x | y)


def corpus(n=420, seed=4):
    """Families of texts with small edits, a third of all rows in one family of copies."""
    pick = random.Random(seed)
    bases = [[f"w{pick.randrange(60 if i % 4 else 4000)}" for _ in range(pick.randrange(1, 25))] for i in range(40)]
    out = []
    for i in range(n):
        w = list(pick.choice(bases))
        for _ in range(pick.randrange(4)):
            w[pick.randrange(len(w))] = f"w{pick.randrange(4000)}"
        if pick.random() < 0.3:
            pick.shuffle(w)
        text = " ".join(w) if i % 3 else "Hot copy of 1,000 words"
        out.append((i, text.upper() if pick.random() < 0.2 else text, pick.choice(["train", "train", "validation", "test", None]), pick.choice(["s1", "s2", None]), pick.choice([0, 1, None])))
    odd = [(n, None), (n + 1, ""), (n + 2, "?!"), (n + 3, "hot COPY of 1'000 words"), (n + 4, "x " * 50_000 + "y z"), (n + 5, "z y x"), (None, "z y x"), (n + 6, "one"), (n + 7, "One!")]
    return out + [(*o, s, "s1", 1) for o, s in zip(odd, ["train", "test"] * 5)]


SCHEMA = "seq_id long, text string, split string, source string, label long"


def table(spark, data):
    # names that the operators use inside
    return spark.createDataFrame(data, SCHEMA).repartition(5).withColumns({"toks": F.lit("clash"), "rep": F.lit(1), "key": F.lit("k"), "side": F.lit(9)})


def brute(data):
    rows = [(i, word_set(t), s) for i, t, s, *_ in data if i is not None]
    return sorted((min(a[0], b[0]), max(a[0], b[0])) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[1] and b[1] and 10 * len(a[1] & b[1]) >= 8 * len(a[1] | b[1])), {i: s for i, _, s in rows}


def test_near_copies_against_brute_force(spark):
    data = corpus()
    want, _ = brute(data)
    assert sorted(map(tuple, NearCopies(table(spark, data), "seq_id", "text").pairs().collect())) == want


@pytest.mark.parametrize("threshold", [0.5, 0.95, 1.0])
def test_other_thresholds(spark, threshold):
    data = corpus(150, 9)
    rows = [(i, word_set(t)) for i, t, *_ in data if i is not None]
    want = {(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[1] and b[1] and len(a[1] & b[1]) >= threshold * len(a[1] | b[1]) - 1e-12}
    assert {tuple(r) for r in NearCopies(table(spark, data), "seq_id", "text", threshold).pairs().collect()} == want


def test_groups_and_links(spark):
    data = [(1, "a b c d e"), (2, "a b c d e"), (3, "a b c d e f"), (4, "a b c d e f g"), (9, "z"), (10, None)]
    found = NearCopies(spark.createDataFrame(data, "seq_id long, text string"), "seq_id", "text").groups()
    got = {r.id: (r.cls, r.grp, r.links) for r in found.collect()}
    assert got == {1: (1, 1, 2), 2: (1, 1, 2), 3: (3, 1, 3), 4: (4, 1, 1), 9: (9, 9, 0)}


def test_long_chain_is_one_group(spark):
    n = 60
    data = [(i, " ".join(f"t{k}" for k in range(i, i + 12))) for i in range(n)]
    found = NearCopies(spark.createDataFrame(data, "seq_id long, text string"), "seq_id", "text").groups()
    assert {r.grp for r in found.collect()} == {0}


def test_cross_split_against_brute_force(spark):
    data = corpus()
    want, split = brute(data)
    kind = lambda i: {"train": 1, "validation": 2, "test": 2}.get(split[i], 0)
    want = sorted(p for p in want if {kind(p[0]), kind(p[1])} == {1, 2})
    cross = CrossSplit(table(spark, data), "seq_id", "text", split_side(F.col("split")), 0, jaccard=0.8)
    assert sorted(map(tuple, found_pairs(cross.overlaps()).collect())) == want
    about = {i: (s, f, y) for i, _, s, f, y in data}
    counted = {}
    for p in want:
        t, h = sorted(p, key=lambda i: about[i][0] != "train")
        c = counted.setdefault(about[h][:2], [0, set(), 0])
        c[0] += 1
        c[1].add(h)
        c[2] += about[t][2] is not None and about[t][2] == about[h][2]
    got = {(r["split"], r["source"]): (r["pairs"], r["held_rows"], r["same_label"]) for r in report(cross, table(spark, data), "seq_id").collect()}
    assert got == {k: (n, len(h), y) for k, (n, h, y) in counted.items()}


def test_weighted_cosine_against_brute_force(spark):
    data = [r for r in corpus(200, 5) if r[0] is not None]
    df = table(spark, data)
    side = split_side(F.col("split"))
    found = CrossSplit(df, "seq_id", "text", side, 0.7, scheme="idf")
    got = {tuple(r)[:2]: r[2] for r in found.links.collect()}
    sets = {r.rep: np.frombuffer(r.toks, np.uint64) for r in found.reps.collect()}
    sides = {r.rep: r.side for r in found.reps.collect()}
    freq, total = W.sketch(found.reps), found.total
    weight = lambda t: np.log1p(total / np.maximum(freq[(t & np.uint64(W.SLOTS - 1)).astype(int)], 1))
    norm = {k: np.sqrt((weight(t) ** 2).sum()) for k, t in sets.items()}
    want = {}
    for a in sets:
        for b in sets:
            if a != b and sides[a] & 1 and sides[b] & 2:
                both = np.intersect1d(sets[a], sets[b])
                cosine = (weight(both) ** 2).sum() / norm[a] / norm[b]
                if cosine >= 0.7:
                    want[a, b] = cosine
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_empty_and_one_sided(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "seq_id long, text string").withColumn("split", F.lit("train"))
    assert NearCopies(df.limit(0), "seq_id", "text").pairs().count() == 0
    assert NearCopies(df, "seq_id", "text").groups().count() == 1
    for rows in (df, df.limit(0)):
        assert CrossSplit(rows, "seq_id", "text", split_side(F.col("split")), 0, jaccard=0.8).overlaps().count() == 0


def test_a_hot_family_that_is_not_similar_is_never_paired(spark):
    """Rows of one template with enough words of their own: its words, in every row, are
    in no list, so nothing meets."""
    hot = " ".join(f"h{k}" for k in range(8))
    df = spark.createDataFrame([(i, f"{hot} a{i} b{i}", "train" if i % 2 else "test") for i in range(3000)], "seq_id long, text string, split string")
    sets = NearCopies(df, "seq_id", "text")
    assert sets.links.count() == 0
    freq = W.sketch(sets.reps)
    lists = prefix_rows(sets.reps, freq, Fraction(8, 9))
    assert lists.groupBy("key").count().agg(F.max("count")).first()[0] == 1
    found = CrossSplit(df, "seq_id", "text", split_side(F.col("split")), 0, jaccard=0.8)
    assert found.links.count() == 0
    listed = inverted_lists(found.reps, 1, freq, max_weights(found.reps, 2, freq, found.total, "binary"), found.total, 8 / 9, "binary", True)
    assert listed.groupBy("key").count().agg(F.max("count")).first()[0] == 1


def test_filters_lose_no_pair_and_drop_many(spark):
    pick = random.Random(3)
    data = []
    for i in range(300):
        own = [f"f{i}_{k}" for k in range(24)]
        data += [(10 * i + j, " ".join(own[: 24 - j] + [f"e{i}_{j}_{k}" for k in range(j)])) for j in range(9)]
    found = NearCopies(spark.createDataFrame(data, "seq_id long, text string").repartition(4), "seq_id", "text")
    steps = [r.pairs for r in found.filtered().collect()]
    want = sum(1 for i in range(300) for a in range(9) for b in range(a) if 10 * len(set(data[9 * i + a][1].split()) & set(data[9 * i + b][1].split())) >= 8 * len(set(data[9 * i + a][1].split()) | set(data[9 * i + b][1].split())))
    assert steps == sorted(steps, reverse=True) and steps[-1] == want
    assert (steps[3] - want) * 4 < (steps[0] - want) * 3


def test_orders_differ(spark):
    flat = np.arange(1, 25, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = [frozenset(W.ordered(flat, np.array([24]), np.ones(W.SLOTS, np.uint32), o)[:8].tolist()) for o in range(3)]
    assert not first[1] & first[2] and len({*first}) == 3
