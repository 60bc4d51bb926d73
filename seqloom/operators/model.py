"""Training and scoring of the default classifier.

Hashed tokens, or the pieces of a WordPiece vocabulary, optionally with a flag of leg
mismatch, go into a linear layer and a softmax of two outputs over sparse features. A
round of training is a warm start from the last round's weights; after each the
validation metrics are taken, the model is saved, and training stops when F1 hasn't
gained for some rounds.
"""

from __future__ import annotations

import json
import logging
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, SQLTransformer
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.scores import with_predictions
from seqloom.functions.tokens import load_vocabulary, save_vocabulary, wordpiece
from seqloom.operators.metrics import binary_metrics

log = logging.getLogger("seqloom")

#: First and last legs of the text, for the optional flag.
_FIRST = r"(?i)\\b(?:LOCK|SRC)\\b[^;|]*?\\b{}=([^\\s;|,]+)"
_LAST = r"(?i)\\b(?:UNLOCK|DST)\\b[^;|]*?\\b{}=([^\\s;|,]+)"


def _pieces(vocabulary: dict[str, int], max_length: int) -> str:
    """The SQL name of a vocabulary's WordPiece function, registered in the session."""
    spark = SparkSession.getActiveSession()
    name = f"wordpiece_{zlib.crc32(json.dumps([vocabulary, max_length]).encode()):08x}"
    spark.udf.register(name, wordpiece(spark, vocabulary, max_length))
    return name


def _features(text_col: str, max_length: int, size: int, flags: bool, vocabulary: dict[str, int] | None = None) -> PipelineModel:
    """Tokens of at most ``max_length`` less two, hashed counts; with ``flags`` a token for
    differing legs, a documented departure from pure text."""
    if vocabulary is None:
        tokens = f"slice(regexp_extract_all(lower(coalesce(`{text_col}`, '')), '([\\\\p{{L}}\\\\p{{N}}_]+|[^\\\\s\\\\p{{L}}\\\\p{{N}}_])', 1), 1, {max_length - 2})"
    else:
        tokens = f"cast({_pieces(vocabulary, max_length)}(`{text_col}`) as array<string>)"
    if flags:
        differs = " OR ".join(f"regexp_extract(`{text_col}`, '{_FIRST.format(k)}', 1) <> regexp_extract(`{text_col}`, '{_LAST.format(k)}', 1)" for k in ("to", "amount"))
        tokens = f"concat({tokens}, if(coalesce({differs}, false), array('[legs differ]'), array()))"
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {tokens} AS _tokens FROM __THIS__"), HashingTF(inputCol="_tokens", outputCol="_features", numFeatures=size)])


def with_text_col(model: PipelineModel, text_col: str) -> PipelineModel:
    """``model`` reading its texts from another column."""
    front = model.stages[0]
    front.setStatement(front.getStatement().replace(f"`{model._text_col}`", f"`{text_col}`"))
    model._text_col = text_col
    return model


def scored(model: PipelineModel, df: DataFrame, pred: str = "pred", prob: str = "prob_abnormal") -> DataFrame:
    """``df`` with the two columns, row for row; columns of these names are replaced."""
    inner = {"_tokens", "_features", "_raw", "_probability", "_prediction"}
    kept = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{model._text_col}`") if hasattr(model, "_text_col") else F.col("text"))
    out = model.transform(kept)
    p = vector_to_array(F.col("_probability"), "float32")
    row = out.select("_row.*", F.get(p, F.lit(1)).alias("__prob"), F.col("_prediction").cast("bigint").alias("__pred"))
    assert not inner & set(df.columns), "a column of the input has a reserved name"
    return row.withColumns({pred: F.col("__pred"), prob: F.col("__prob")}).drop("__pred", "__prob")


def _layer(previous: LogisticRegressionModel | None, iterations: int) -> LogisticRegression:
    """A softmax regression that starts from the weights of ``previous``."""
    layer = LogisticRegression(family="multinomial", featuresCol="_features", labelCol="_label", predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw", maxIter=iterations, regParam=0.0, standardization=False)
    if previous is not None:
        layer._java_obj.setInitialModel(previous._java_obj)
    return layer


def _sparse(vector: Column) -> tuple[Column, Column]:
    """Indexes and values of a sparse vector, from its text ``(size,[i,…],[v,…])``."""
    lists = F.regexp_extract_all(vector.cast("string"), F.lit(r"\[([^\]]*)\]"), F.lit(1))
    numbers = lambda at, kind: F.transform(F.filter(F.split(F.get(lists, F.lit(at)), ","), lambda x: x != ""), lambda x: x.cast(kind))
    return numbers(0, "int"), numbers(1, "double")


#: Weights that one row carries when the tasks' weights are averaged.
PART = 1 << 14


class Minibatch:
    """Minibatch training of the same layer: each task goes once through its rows in steps
    of ``batch_size``, by adaptive gradient steps from the common weights, and the tasks'
    weights are averaged by their rows. ``state`` holds the difference of the two outputs'
    weights, the intercept last, and the sums of squared gradients behind them."""

    def __init__(self, spark: SparkSession, features: int, batch_size: int, seed: int, rate: float = 0.3) -> None:
        self.spark, self.features, self.batch_size, self.seed, self.rate = spark, features, max(batch_size, 1), seed, rate
        self.state = np.zeros(2 * (features + 1))

    def round(self, data: DataFrame, epoch: int) -> None:
        """One epoch over ``data`` (_label, _features)."""
        shared = self.spark.sparkContext.broadcast(self.state)
        size, batch_size, rate, seed = self.features + 1, self.batch_size, self.rate, self.seed + epoch

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, rows, pick = shared.value.copy(), 0, np.random.default_rng(seed)
            w, squares = state[:size], state[size:]
            for b in batches:
                label = np.asarray(b.column("label"))
                ends = np.asarray(b.column("i").offsets).astype(np.int64)
                at, value = b.column("i").flatten().to_numpy(), b.column("v").flatten().to_numpy()
                order = pick.permutation(len(label))
                for k in range(0, len(label), batch_size):
                    own = order[k : k + batch_size]
                    spans = [np.arange(ends[r] - ends[0], ends[r + 1] - ends[0]) for r in own]
                    lengths = np.array([len(x) for x in spans])
                    flat = np.concatenate(spans)
                    i, v, row = at[flat], value[flat], np.repeat(np.arange(len(own)), lengths)
                    z = np.bincount(row, w[i] * v, len(own)) + w[-1]
                    slip = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[own]) / len(own)
                    where, back = np.unique(np.r_[i, size - 1], return_inverse=True)
                    slope = np.bincount(back, np.r_[slip[row] * v, slip.sum()])
                    squares[where] += slope * slope
                    w[where] -= rate * slope / np.sqrt(squares[where] + 1e-12)
                rows += len(label)
            if rows:
                parts = range(0, len(state), PART)
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([rows] * len(parts), pa.int64()), pa.array([state[p : p + PART].tobytes() for p in parts], pa.binary())], ["part", "n", "w"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for b in batches:
                for part, n, w in zip(*(c.to_pylist() for c in b.columns)):
                    own = held.setdefault(part, [0, 0.0])
                    own[0], own[1] = own[0] + n, own[1] + n * np.frombuffer(w)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([(w / n).tobytes() for n, w in held.values()], pa.binary())], ["part", "w"])

        i, v = _sparse(F.col("_features"))
        sent = data.select(F.col("_label").alias("label"), i.alias("i"), v.alias("v")).mapInArrow(train, "part long, n long, w binary")
        for r in sent.repartition("part").mapInArrow(merge, "part long, w binary").collect():  # as many numbers as the state has
            self.state[r["part"] : r["part"] + PART] = np.frombuffer(r["w"])

    def model(self) -> LogisticRegressionModel:
        """The weights as a model of Spark."""
        w = self.state[: self.features + 1] / 2
        jvm = self.spark._jvm
        matrix = Matrices.dense(2, self.features, np.stack([-w[:-1], w[:-1]], 1).ravel())
        java = jvm.org.apache.spark.ml.classification.LogisticRegressionModel("minibatch", _py2java(self.spark.sparkContext, matrix), _py2java(self.spark.sparkContext, Vectors.dense(-w[-1], w[-1])), 2, True)
        model = LogisticRegressionModel(java)
        model._resetUid("minibatch")
        for setter, column in (("setFeaturesCol", "_features"), ("setPredictionCol", "_prediction"), ("setProbabilityCol", "_probability"), ("setRawPredictionCol", "_raw")):
            getattr(model, setter)(column)
        return model


def fit(
    train: DataFrame,
    validation: DataFrame,
    *,
    text_col: str = "text",
    label_col: str = "label",
    epochs: int = 5,
    iterations: int = 10,
    batch_size: int = 8,
    max_length: int = 256,
    features: int = 4096,
    patience: int = 2,
    flags: bool = False,
    seed: int = 42,
    out_dir: str | None = None,
    vocabulary: dict[str, int] | None = None,
    minibatch: bool = False,
) -> tuple[PipelineModel, list[dict]]:
    """The model of the best F1 (the earliest among equals) and the history of rounds.

    Training and validation texts are turned into features once. A round is ``iterations``
    steps of L-BFGS, each over all rows, for which ``batch_size`` and ``seed`` change
    nothing; with ``minibatch`` it is one pass in steps of ``batch_size`` rows. Labels other than 0 and 1 raise. Each round's model is kept in ``out_dir``/epoch=N."""
    front = _features(text_col, max_length, features, flags, vocabulary)
    classes = {"ml_attr": {"type": "nominal", "vals": ["0", "1"], "name": "_label"}}

    def featured(df: DataFrame, label: Column) -> DataFrame:
        return front.transform(df.select(text_col, label.cast("double").alias("_label", metadata=classes))).select("_label", "_features").persist()

    data = featured(train, F.when(F.col(label_col).isin(0, 1), F.col(label_col)).otherwise(F.raise_error(F.lit("labels are 0 and 1"))))
    held = featured(validation, F.col(label_col))
    history: list[dict] = []
    best: tuple[float, PipelineModel] | None = None
    fitted: LogisticRegressionModel | None = None
    steps = Minibatch(train.sparkSession, features, batch_size, seed) if minibatch else None
    try:
        for epoch in range(1, epochs + 1):
            if steps:
                steps.round(data, epoch)
                fitted = steps.model()
            else:
                fitted = _layer(fitted, iterations).fit(data)
            model = PipelineModel([*front.stages, fitted])
            model._text_col, model._max_length, model._vocabulary = text_col, max_length, vocabulary
            if out_dir:
                save(model, f"{out_dir}/epoch={epoch}")
            row = binary_metrics(fitted.transform(held).select(F.col("_label").alias("label"), F.col("_prediction").alias("pred"))).first().asDict() | {"epoch": epoch}
            history.append(row)
            log.info("epoch %d: %s", epoch, row)
            if best is None or row["f1"] > best[0]:
                best, since = (row["f1"], model), 0
            else:
                since += 1
                if since >= patience:
                    break
    finally:
        data.unpersist()
        held.unpersist()
    assert best is not None, "no epochs"
    return best[1], history


def evaluate(model: PipelineModel, df: DataFrame, label_col: str = "label"):
    """The metrics of ``model`` on ``df`` as a row."""
    return binary_metrics(scored(model, df), label_col).first()


def save(model: PipelineModel, path: str, **options) -> None:
    """Model, tokenizer stages, vocabulary and options in one folder, replacing what was there."""
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    options |= {"text_col": getattr(model, "_text_col", "text"), "max_length": getattr(model, "_max_length", 256)}
    vocabulary = getattr(model, "_vocabulary", None)
    if vocabulary is not None:
        save_vocabulary(spark, vocabulary, f"{path}/tokenizer")
    spark.createDataFrame([(json.dumps(options | {"wordpiece": vocabulary is not None}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/options")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the session's file system has ``path``."""
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(context._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str) -> PipelineModel:
    """A saved model; the folder of a training run stands for its best model."""
    if not exists(spark, f"{path}/options") and exists(spark, f"{path}/best"):
        path = f"{path}/best"
    model = PipelineModel.load(path)
    options = json.loads(spark.read.text(f"{path}/options").first()[0])
    model._text_col, model._max_length = options["text_col"], options["max_length"]
    model._vocabulary = load_vocabulary(spark, f"{path}/tokenizer") if options["wordpiece"] else None
    if model._vocabulary is not None:
        _pieces(model._vocabulary, model._max_length)
    return model


def score_with(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 64) -> DataFrame:
    """``df`` with the predictions of any scorer: ``make()`` runs once in each worker and
    returns a function of texts to an (n, 2) array of logits, called with at most
    ``batch_size`` texts. Null texts are scored as empty ones."""

    @F.pandas_udf("array<float>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = make()
        for texts in batches:
            values = [None if x is None else str(x) for x in texts]
            rows = [score([v or "" for v in values[i : i + batch_size]]) for i in range(0, len(values), batch_size)]
            yield pd.Series([r.astype(np.float32) for part in rows for r in np.asarray(part)], dtype=object)

    return with_predictions(df.withColumn("_logits", logits(F.col(f"`{text_col}`"))), "_logits")
