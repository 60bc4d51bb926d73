import pytest

from seqloom.operators.metrics import bad_scores, best_epochs, binary_metrics, early_stopping
from seqloom.sources.csvfiles import labelled, read_csv


def metrics(spark, pairs):
    return binary_metrics(spark.createDataFrame(pairs, "label long, pred long")).first().asDict()


def test_sample_predictions(spark):
    df = read_csv(spark, "tests/fixtures/preds.csv").selectExpr("cast(label as bigint) label", "cast(pred as bigint) pred")
    m = binary_metrics(df).first()
    assert (m.accuracy, m.precision, m.recall, m.f1, m.support) == (0.5, 0, 0, 0, 2)


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([(0, 0), (0, 0)], (1, 0, 0, 0)),
        ([(1, 1), (1, 1)], (1, 1, 1, 1)),
        ([(1, 0), (0, 1)], (0, 0, 0, 0)),
        ([(1, 1), (1, 0), (0, 1), (0, 0)], (0.5, 0.5, 0.5, 0.5)),
        ([], (0, 0, 0, 0)),
        ([(None, 1), (1, None), (1, 1)], (1, 1, 1, 1)),
    ],
)
def test_corner_cases(spark, pairs, want):
    m = metrics(spark, pairs)
    assert tuple(m[k] for k in ("accuracy", "precision", "recall", "f1")) == want


def history(spark, values):
    return spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(values)], "run_id int, epoch int, f1 double")


@pytest.mark.parametrize("values, stop, best", [([0.0, 0.5, 0.5, 0.4, 0.9], 4, 2), ([0.0, 0.0, 0.0, 0.0], 3, 1), ([0.1, 0.2, 0.3], None, 3), ([None, None, 0.3], 2, None), ([None, 0.4, 0.4], None, 2)])
def test_stop_and_best(spark, values, stop, best):
    rows = early_stopping(history(spark, values)).where("stop").orderBy("epoch").collect()
    assert (rows[0].epoch if rows else None) == stop
    found = best_epochs(history(spark, values), patience=2).collect()
    assert (found[0].epoch if found else None) == best


def test_best_without_stop_takes_the_earliest_tie(spark):
    assert best_epochs(history(spark, [0.1, 0.9, 0.9])).first().epoch == 2


def test_bad_scores(spark):
    df = spark.createDataFrame([(1, 0.5), (1, float("nan")), (1, None), (2, 0.1)], "run_id int, prob_abnormal float")
    assert {r.run_id: (r.scored, r.null_scores, r.nan_scores) for r in bad_scores(df, by=("run_id",)).collect()} == {1: (3, 1, 1), 2: (1, 0, 0)}
