"""python -m seqloom.cli.predict: score a CSV file with a saved model."""

from __future__ import annotations

import argparse
import importlib
import logging

from pyspark.sql import DataFrame, SparkSession

from seqloom.operators.model import load, score_with, scored, with_text_col
from seqloom.session import local_session
from seqloom.sources.csvfiles import read_csv, write_csv

log = logging.getLogger("seqloom")


def predict(
    spark: SparkSession, model: str = "models/binary", csv: str = "data/val.csv", text_col: str = "text", out: str = "preds.csv", max_length: int = 256, one_file: bool = True, scorer: str | None = None, batch_size: int = 64, split_files: bool = False
) -> DataFrame:
    """Write the input's columns and ``pred``, ``prob_abnormal`` to ``out`` and return them.
    ``model`` is a saved model or the folder of a training run; ``max_length`` is the
    model's own, another value is refused. ``scorer`` (``module:function``) names any other
    model instead: a function of ``model`` and ``max_length`` that returns a function of
    texts to an (n, 2) array of logits, built once in each worker."""
    rows = read_csv(spark, csv, multi_line=not split_files)
    if text_col not in rows.columns:
        raise ValueError(f"no column {text_col!r} in {rows.columns}")
    if scorer:
        module, _, name = scorer.partition(":")
        result = score_with(rows, text_col, lambda: getattr(importlib.import_module(module), name)(model, max_length), batch_size)
    else:
        fitted = with_text_col(load(spark, model), text_col)
        if fitted._max_length != max_length:
            raise ValueError(f"the model wasn't trained with max_length={max_length}")
        result = scored(fitted, rows)
    write_csv(result, out, one_file)
    log.info("wrote %s", out)
    return result


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    # Names of the first five options and the defaults of four of them.
    p.add_argument("--model", default="models/binary")
    p.add_argument("--csv", default="data/val.csv")
    p.add_argument("--text_col", default="text")
    p.add_argument("--out", default="preds.csv")
    p.add_argument("--max_length", type=int, default=256)
    p.add_argument("--many_files", dest="one_file", action="store_false")
    p.add_argument("--split_files", action="store_true")
    p.add_argument("--scorer")
    p.add_argument("--batch_size", type=int, default=64)
    logging.basicConfig(level=logging.INFO)
    predict(local_session(), **vars(p.parse_args(args)))


if __name__ == "__main__":
    main()
