import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from seqloom.sources.csvfiles import labelled, read_csv, read_splits, write_csv


def put(tmp_path, text):
    p = tmp_path / "in.csv"
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_reference_rows(spark):
    splits = read_splits(spark, {"train": "tests/fixtures/train.csv", "validation": "tests/fixtures/val.csv"})
    assert [r.label for r in labelled(splits["train"]).collect()] == [0, 0, 1, 1, 0]
    assert [r.label for r in labelled(splits["validation"]).collect()] == [1, 0]


def test_round_trip(spark, tmp_path):
    values = [('a "quoted" text', "1.50"), ("comma, inside", ""), ("line\nbreak", "x"), ("back\\slash", "NA"), ("日本", "é")]
    df = spark.createDataFrame(values, "text string, other string")
    write_csv(df, str(tmp_path / "out"))
    back = [(r.text, r.other or "") for r in read_csv(spark, str(tmp_path / "out")).collect()]
    assert sorted(back) == sorted(values)


def test_columns_go_by_name(spark, tmp_path):
    df = labelled(read_csv(spark, put(tmp_path, "label,extra,text\n1,e,hello\n")))
    assert df.select("text", "label").first() == ("hello", 1)


@pytest.mark.parametrize("body", ["text,label\na,1.7\n", "text,label\na,x\n", "text,label\na\n", "text,label\na,1,2\n", "text,label\na,\n"])
def test_bad_records_raise(spark, tmp_path, body):
    with pytest.raises((PySparkException, Py4JJavaError)):
        labelled(read_csv(spark, put(tmp_path, body))).collect()


def test_missing_column_raises(spark, tmp_path):
    with pytest.raises(ValueError):
        labelled(read_csv(spark, put(tmp_path, "body,label\na,1\n")))


def test_nulls_can_be_dropped_and_named(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "text,label\na,1\nNA,0\nb,\n"), missing=("NA",))
    assert [tuple(r) for r in labelled(df, drop_null=True).collect()] == [("a", 1)]


def test_empty_file_with_header(spark, tmp_path):
    assert labelled(read_csv(spark, put(tmp_path, "text,label\n"))).count() == 0
