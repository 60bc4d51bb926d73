import random

from seqloom.llm import leakage
from seqloom.llm.leakage import cleaned, leaks, windows
from seqloom.llm.words import words


def fixture(seed=1):
    pick = random.Random(seed)
    word = lambda: f"w{pick.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(pick.choice([5, 9, 10, 11, 30])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, items[0][1] + " shared tail"), (None, " ".join(f"n{k}" for k in range(12))), (103, "rep " * 40)]
    docs = []
    for i in range(200):
        body = [word() for _ in range(pick.randrange(60))]
        source = words(pick.choice(items)[1])
        if i % 3 == 0 and source:
            a = pick.randrange(len(source))
            body[3:3] = source[a : a + pick.choice([8, 9, 10, 15])]
        docs.append((i, ", ".join(w.upper() if pick.random() < 0.2 else w for w in body)))
    return docs + [(500, None), (501, ""), (502, items[4][1]), (502, items[4][1]), (None, items[4][1]), (503, "x " * 40_000 + items[4][1]), (504, "rep " * 12), (505, " ".join(f"n{k}" for k in range(12)))], items


def grams(text, n=10):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items):
    return {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item long, doc int").repartition(4), spark.createDataFrame(items, "item_id long, text string")


def test_both_ways_against_brute_force(spark):
    docs, items = fixture()
    d, i = tables(spark, docs, items)
    want = brute(docs, items)
    assert len(want) > 8
    for most in (10**6, 3):  # by broadcast, by shuffle
        found = leaks(d, i, "doc_id", "item_id", most=most).collect()
        assert len(found) == len(set(map(tuple, found))) and {tuple(r) for r in found} == want


def test_spans_and_documents_are_removed(spark):
    docs, items = fixture(2)
    d, i = tables(spark, docs, items)
    bad = {x for x, _ in brute(docs, items)}
    out = cleaned(d, i, "doc_id", "item_id").collect()
    assert len(out) == len(docs)
    assert {r.doc for r in out if r.spans} == bad
    all_grams = set().union(*(grams(t) for _, t in items))
    assert not any(grams(part) & all_grams for r in out if not r.spans for part in [r.text])
    assert {r.text for r in out if r.doc == 502} == {""}
    kept = {r.doc for r in cleaned(d, i, "doc_id", "item_id", whole=True).collect()}
    assert kept - {None} == {x for x, _ in docs} - bad - {None}


def test_windows_stay_inside_their_text():
    h, row, first = windows(["a b c", None, "", "d e", "a b c d"], 3)
    assert row.tolist() == [0, 4, 4] and first.tolist() == [0, 0, 1] and h[0] == h[1]


def test_empty_tables(spark):
    d, i = tables(spark, *fixture())
    assert leaks(d.limit(0), i, "doc_id", "item_id").count() == 0
    assert leaks(d, i.limit(0), "doc_id", "item_id").count() == 0
    assert cleaned(d, i.limit(0), "doc_id", "item_id").where("spans > 0").count() == 0


def test_spans_are_cut_by_shuffle_as_by_broadcast(spark):
    d, i = tables(spark, *fixture(3))
    key = lambda r: (r.doc is None, r.doc or 0, r.text or "", r.spans)
    by_broadcast, by_shuffle = (sorted(cleaned(d, i, "doc_id", "item_id", most=most).collect(), key=key) for most in (10**6, 3))
    assert by_broadcast == by_shuffle and sum(r.spans for r in by_shuffle) > 4


def test_equal_hashes_of_other_words_are_no_leak(spark, monkeypatch):
    """Hits are verified on words on both ways, however the hashes fall."""
    monkeypatch.setattr(leakage, "hash_words", lambda found: leakage.np.full(len(found), 3, leakage.np.uint64))
    items = [(1, " ".join(f"a{k}" for k in range(10)))]
    docs = [(1, " ".join(f"b{k}" for k in range(10))), (2, items[0][1])]
    texts = [t for _, t in docs]
    assert leakage.Grams(items, 10).hits(texts) == {0: [], 1: [(0, 1)]}
    rows = spark.createDataFrame([(0, 1, "x y"), (0, 1, "x z")], "id long, h long, gram string")
    assert rows.join(rows.limit(1).select("h", "gram"), ["h", "gram"]).count() == 1


def test_bytes_of_items_are_checked(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_BYTES", 100)
    docs, items = fixture(4)
    d, i = tables(spark, docs, items)
    assert leakage.Items(i, "item_id", "text", 10, 10**6).shared is None
    assert {tuple(r) for r in leaks(d, i, "doc_id", "item_id").collect()} == brute(docs, items)
    for whole in (False, True):
        kept = [sorted(map(str, cleaned(d, i, "doc_id", "item_id", whole=whole, most=m).collect())) for m in (10**6, 0)]
        assert kept[0] == kept[1]


def test_clashing_columns_and_empty_tables_beyond_the_bound(spark):
    from pyspark.sql import functions as F

    docs, items = fixture(6)
    d, i = tables(spark, docs, items)
    d, i = (x.withColumns({c: F.lit("clash") for c in ("id", "h", "gram", "first", "t1", "spans")}) for x in (d, i))
    assert {tuple(r) for r in leaks(d, i, "doc_id", "item_id", most=3).collect()} == brute(docs, items)
    assert cleaned(d, i, "doc_id", "item_id", most=3).count() == len(docs)
    assert leaks(d.limit(0), i, "doc_id", "item_id", most=3).count() == cleaned(d.limit(0), i, "doc_id", "item_id", most=3).count() == 0
