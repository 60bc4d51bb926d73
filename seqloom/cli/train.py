"""python -m seqloom.cli.train: fit a classifier on labelled CSV files."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from seqloom.functions.tokens import load_vocabulary
from seqloom.operators.model import evaluate, exists, fit, save
from seqloom.session import local_session
from seqloom.sources.csvfiles import labelled, read_splits

log = logging.getLogger("seqloom")


def train(
    spark: SparkSession,
    train_csv: str = "data/train.csv",
    val_csv: str = "data/val.csv",
    model_name: str = "hashed-linear",
    out_dir: str = "models/binary",
    epochs: int = 5,
    batch_size: int = 8,
    max_length: int = 256,
    drop_null: bool = False,
    split_files: bool = False,
    minibatch: bool = False,
) -> dict:
    """Read both files, train, keep the best model in ``out_dir`` and return its metrics
    with the prefix ``eval_``. ``model_name`` is ``hashed-linear``, a folder with the
    vocab.txt of a WordPiece tokenizer, or either with ``-legs`` behind it for the flag of
    differing legs as a feature. ``minibatch`` trains in steps of ``batch_size`` rows, else
    all rows make a step. ``split_files`` reads files without line breaks inside
    quotes in many tasks."""
    base = model_name.removesuffix("-legs")
    vocabulary = None if base == "hashed-linear" else load_vocabulary(spark, base) if exists(spark, f"{base}/vocab.txt") else {}
    if vocabulary == {}:
        raise ValueError(f"unknown model {model_name!r}")
    files = read_splits(spark, {"train": train_csv, "validation": val_csv}, multi_line=not split_files)
    splits = {k: labelled(v, drop_null=drop_null).select("text", "label") for k, v in files.items()}
    model, history = fit(splits["train"], splits["validation"], epochs=epochs, batch_size=batch_size, max_length=max_length, flags=model_name.endswith("-legs"), out_dir=out_dir, vocabulary=vocabulary, minibatch=minibatch)
    metrics = {f"eval_{k}": v for k, v in evaluate(model, splits["validation"]).asDict().items()}
    save(model, out_dir + "/best", model_name=model_name, epochs_run=len(history))
    log.info("validation: %s; saved to %s", metrics, out_dir)
    return metrics


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    # Names and defaults of the first seven options.
    p.add_argument("--train_csv", default="data/train.csv")
    p.add_argument("--val_csv", default="data/val.csv")
    p.add_argument("--model_name", default="hashed-linear")
    p.add_argument("--out_dir", default="models/binary")
    p.add_argument("--epochs", type=int, default=5)
    p.add_argument("--batch_size", type=int, default=8)
    p.add_argument("--max_length", type=int, default=256)
    p.add_argument("--drop_null", action="store_true")
    p.add_argument("--split_files", action="store_true")
    p.add_argument("--minibatch", action="store_true")
    logging.basicConfig(level=logging.INFO)
    train(local_session(), **vars(p.parse_args(args)))


if __name__ == "__main__":
    main()
