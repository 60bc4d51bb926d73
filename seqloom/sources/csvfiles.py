"""CSV source and sink of labelled texts.

Columns are found by name, never by position; a ragged record stops the read. Values
stay as written (``1.50`` isn't turned into a number) until a column is cast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = ("", "NA", "NaN", "nan", "null", "NULL", "None", "N/A")


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True, missing: tuple[str, ...] = ()) -> DataFrame:
    """All columns as strings. ``multi_line=False`` lets Spark split large files, for
    files without line breaks inside quotes; ``missing`` names values that become null."""
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', mode="FAILFAST", encoding="UTF-8")
    if missing:
        df = df.select(*[F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df


def read_splits(spark: SparkSession, files: dict[str, str | list[str]], **options) -> dict[str, DataFrame]:
    """One DataFrame a split."""
    return {split: read_csv(spark, path, **options) for split, path in files.items()}


def labelled(df: DataFrame, text_col: str = "text", label_col: str = "label", drop_null: bool = False) -> DataFrame:
    """(text, label, others…) with an integer label.

    A label that is no integer raises, as does a null text or label, unless
    ``drop_null``: then rows with a null are left out."""
    for c in (text_col, label_col):
        if c not in df.columns:
            raise ValueError(f"no column {c!r} in {df.columns}")
    label = F.col(f"`{label_col}`")
    if isinstance(df.schema[label_col].dataType, T.StringType):
        label = F.when(label.rlike(r"^\s*[+-]?\d+\s*$") | label.isNull(), label.try_cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("label is no integer: "), label)).cast("bigint"))
    out = df.withColumn(label_col, label.cast("bigint"))
    null = F.col(f"`{text_col}`").isNull() | F.col(f"`{label_col}`").isNull()
    if drop_null:
        return out.where(~null)
    checked = F.when(F.col(f"`{text_col}`").isNull(), F.raise_error(F.lit("null text")).cast("string")).otherwise(F.col(f"`{text_col}`"))
    return out.withColumn(text_col, checked).withColumn(label_col, F.coalesce(F.col(f"`{label_col}`"), F.raise_error(F.lit("null label")).cast("bigint")))


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """Header, doubled quotes, empty strings empty, overwritten; a folder of part files.
    ``one_file`` suits results that are read by hand; large ones leave it off."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", encoding="UTF-8")
