import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.cli.predict import predict
from seqloom.cli.train import train
from seqloom.operators.model import evaluate, fit, load, save, score_with, scored
from seqloom.sources.csvfiles import read_csv


def separable(spark, n=60):
    return spark.createDataFrame([(f"row {i} {'bad' if i % 3 == 0 else 'good'}", int(i % 3 == 0)) for i in range(n)], "text string, label long")


def test_separable_set_and_round_trip(spark, tmp_path):
    df = separable(spark)
    model, history = fit(df, df, epochs=5, features=256, out_dir=str(tmp_path / "m"))
    assert evaluate(model, df).f1 == 1
    assert len(history) <= 5 and (tmp_path / "m" / "epoch=1").exists()
    save(model, str(tmp_path / "m" / "best"))
    again = load(spark, str(tmp_path / "m" / "best"))
    key = lambda m, d: sorted((r.text, r.pred, r.prob_abnormal) for r in scored(m, d).collect())
    assert key(model, df) == key(again, df) == key(model, df.repartition(7))


def test_patience_stops_training(spark):
    df = separable(spark)
    _, history = fit(df, df.where("label = 0"), epochs=6, features=64, iterations=1)
    assert len(history) == 3  # F1 stays 0


def test_scores_keep_rows_and_columns(spark):
    df = separable(spark).withColumn("pred", F.lit("old")).withColumn("extra", F.lit(None).cast("int")).unionByName(spark.createDataFrame([(None, None, "p", 1), ("", None, "p", 1), ("long " * 20_000, 0, "p", 1)], "text string, label long, pred string, extra int"))
    model, _ = fit(separable(spark), separable(spark), epochs=1, features=64)
    out = scored(model, df)
    assert out.columns == ["text", "label", "pred", "extra", "prob_abnormal"] and out.count() == df.count()
    assert scored(model, df.limit(0)).count() == 0
    assert out.where("(pred = 1) <> (prob_abnormal > 0.5)").count() == 0


def test_bad_labels_raise(spark):
    df = separable(spark).withColumn("label", F.lit(2).cast("long"))
    with pytest.raises(Exception, match="labels are 0 and 1"):
        fit(df, df, epochs=1, features=64)


def test_leg_flag_teaches_what_tokens_cannot(spark):
    pick = random.Random(3)
    data = []
    for _ in range(600):
        a, b, label = pick.randrange(40), pick.randrange(39), pick.randrange(2)
        b = (a + 1 + b) % 40 if label else a
        data.append((f"LOCK tx=1 to=name{a} amount=5; UNLOCK tx=2 to=name{b} amount=5", label))
    df = spark.createDataFrame(data, "text string, label long")
    train, test = spark.createDataFrame(data[:400], df.schema), spark.createDataFrame(data[400:], df.schema)
    with_flag, without = (evaluate(fit(train, test, epochs=3, features=1024, flags=flags)[0], test).f1 for flags in (True, False))
    assert with_flag > 0.9 > without


@pytest.mark.parametrize("size", [1, 8, 64])
def test_any_scorer(spark, size):
    def make():
        return lambda texts: np.array([[0.0, len(t)] for t in texts])

    df = spark.createDataFrame([("abc", 1), (None, 2), ("", 3)], "text string, k int")
    got = {r.k: (r.pred, round(r.prob_abnormal, 4)) for r in score_with(df, "text", make, size).collect()}
    assert got == {1: (1, 0.9526), 2: (0, 0.5), 3: (0, 0.5)}


def test_programs_end_to_end(spark, tmp_path):
    metrics = train(spark, "tests/fixtures/train.csv", "tests/fixtures/val.csv", out_dir=str(tmp_path / "m"), epochs=2)
    assert {"eval_f1", "eval_accuracy", "eval_precision", "eval_recall"} <= set(metrics)
    predict(spark, str(tmp_path / "m" / "best"), "tests/fixtures/val.csv", out=str(tmp_path / "p"))
    back = read_csv(spark, str(tmp_path / "p"))
    assert back.columns == ["text", "label", "pred", "prob_abnormal"] and back.count() == 2
    renamed = str(tmp_path / "r.csv")
    with open(renamed, "w") as f:
        f.write("body\nLOCK tx=0x1 to=A amount=1\n")
    assert predict(spark, str(tmp_path / "m" / "best"), renamed, text_col="body", out=str(tmp_path / "q")).columns == ["body", "pred", "prob_abnormal"]
    with pytest.raises(ValueError):
        predict(spark, str(tmp_path / "m" / "best"), renamed, text_col="nope", out=str(tmp_path / "q"))


def test_queries_train_with_the_defaults_of_fit(monkeypatch):
    import inspect

    from seqloom import queries

    given = []

    class Seen(Exception):
        pass

    def spy(*args, **kwargs):
        bound = inspect.signature(fit).bind(*args, **kwargs)
        bound.apply_defaults()
        given.append(tuple(bound.arguments[k] for k in ("epochs", "iterations", "features", "patience")))
        raise Seen

    class Rows:
        where = lambda self, _: self

    monkeypatch.setattr(queries, "fit", spy)
    monkeypatch.setattr(queries, "labelled_text", lambda *_: Rows())
    for query in (queries.train_predict, queries.train_metrics):
        with pytest.raises(Seen):
            query(None, "")
    assert given == [(5, 10, 4096, 2)] * 2


def length_scorer(model, max_length):
    """A scorer as ``--scorer`` names it."""
    return lambda texts: np.array([[0.0, min(len(t), max_length) - 200.0] for t in texts])


def test_predict_with_any_model(spark, tmp_path):
    out = predict(spark, "any", "tests/fixtures/val.csv", out=str(tmp_path / "p"), scorer="tests.test_model:length_scorer", one_file=False)
    assert all(r.pred == (len(r.text) > 200) for r in out.collect())


def test_training_with_a_vocabulary_folder(spark, tmp_path):
    from seqloom.functions.tokens import save_vocabulary

    letters = "abcdefghijklmnopqrstuvwxyz0123456789_=;"
    save_vocabulary(spark, {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *letters, *["##" + c for c in letters]])}, str(tmp_path / "v"))
    out = str(tmp_path / "m")
    train(spark, "tests/fixtures/train.csv", "tests/fixtures/val.csv", model_name=str(tmp_path / "v"), out_dir=out, epochs=2, max_length=64, split_files=True)
    got = predict(spark, out, "tests/fixtures/val.csv", out=str(tmp_path / "p"), max_length=64)  # the run's folder stands for its best model
    assert got.columns == ["text", "label", "pred", "prob_abnormal"] and got.where("prob_abnormal between 0 and 1").count() == 2
    again = load(spark, out)
    assert len(again._vocabulary) == 4 + 2 * len(letters)
    with pytest.raises(ValueError, match="max_length"):
        predict(spark, out, "tests/fixtures/val.csv", out=str(tmp_path / "p"))
    with pytest.raises(ValueError, match="unknown model"):
        train(spark, "tests/fixtures/train.csv", "tests/fixtures/val.csv", model_name="none", out_dir=out)


def test_rounds_start_from_the_last_weights(spark):
    df = separable(spark, 300)
    long = fit(df, df, epochs=1, iterations=40, features=256)[0].stages[-1].coefficientMatrix.toArray()
    short = fit(df, df, epochs=4, iterations=1, features=256, patience=9)
    first = fit(df, df, epochs=1, iterations=1, features=256)[0].stages[-1].coefficientMatrix.toArray()
    assert short[1][-1]["f1"] >= short[1][0]["f1"]
    assert np.abs(long - first).max() > 0


def test_one_class_only(spark):
    df = separable(spark).where("label = 0")
    model, history = fit(df, df, epochs=2, features=64)
    assert scored(model, df).where("pred = 0 and prob_abnormal < 0.5").count() == df.count() and history[0]["f1"] == 0


@pytest.mark.parametrize("size", [1, 8, 64])
def test_minibatch_training(spark, tmp_path, size):
    df = separable(spark, 400).repartition(3)
    model, history = fit(df, df, epochs=5, features=4096, batch_size=size, minibatch=True)
    assert evaluate(model, df).f1 > 0.98 and max(h["f1"] for h in history) == evaluate(model, df).f1
    save(model, str(tmp_path / "m"))
    key = lambda m: sorted((r.text, r.pred, r.prob_abnormal) for r in scored(m, df).collect())
    assert key(load(spark, str(tmp_path / "m"))) == key(model)


def test_minibatch_steps_against_a_plain_loop(spark):
    """One task, one row a step: the weights of the written-out rule."""
    from seqloom.operators.model import Minibatch

    vectors = [{1: 1.0, 3: 2.0}, {0: 1.0}, {}, {3: 1.0, 2: 1.0}, {1: 3.0}]
    labels = [1.0, 0.0, 1.0, 0.0, 1.0]
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(y, Vectors.sparse(4, v)) for y, v in zip(labels, vectors)], ["_label", "_features"]).coalesce(1)
    steps = Minibatch(spark, 4, 1, seed=5)
    w, squares = np.zeros(5), np.zeros(5)
    for epoch in (1, 2):
        steps.round(df, epoch)
        for r in np.random.default_rng(5 + epoch).permutation(5):
            z = sum(w[i] * x for i, x in vectors[r].items()) + w[4]
            g = 1 / (1 + np.exp(-z)) - labels[r]
            for i, x in [*vectors[r].items(), (4, 1.0)]:
                squares[i] += (g * x) ** 2
                w[i] -= 0.3 * g * x / np.sqrt(squares[i] + 1e-12)
    assert np.allclose(steps.state, np.r_[w, squares])


def test_minibatch_without_rows(spark):
    df = separable(spark)
    model, _ = fit(df.limit(0), df, epochs=1, features=64, minibatch=True)
    assert scored(model, df).where("prob_abnormal = 0.5").count() == df.count()
