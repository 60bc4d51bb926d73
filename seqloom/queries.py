"""The registered queries of the core, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.scores import argmax, softmax, with_predictions
from seqloom.functions.tokens import IDEOGRAPHS, SYMBOLS, basic_tokens, encoded, mask, padded, truncated, whitespace_words, words
from seqloom.operators.metrics import bad_scores, best_epochs, binary_metrics, early_stopping
from seqloom.operators.model import evaluate, fit, scored
from seqloom.operators.records import failures, parse_blocks, parse_records, valid_rows
from seqloom.operators.sequences import broken_links, latest_delivery, legs, parsed, render, review_queue, steps_of
from seqloom.sources.csvfiles import labelled
from seqloom.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return failures(parse_records(table(spark, d, "raw_lines"), table(spark, d, "raw_files"))).select("line_id", "reason").distinct()


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    return valid_rows(parse_records(table(spark, d, "raw_lines"), table(spark, d, "raw_files")))


def p5_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Records of the files' text in blocks of lines, read with recovery."""
    return parse_blocks(table(spark, d, "raw_lines"), table(spark, d, "raw_files"))


def labelled_text(spark: SparkSession, d: str) -> DataFrame:
    return labelled(table(spark, d, "sequences", "seq_id", "text", "label", "split"), drop_null=True)


def split_selection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sequences", "seq_id", "split", "label").where("split = 'validation'").select("seq_id", F.col("label").alias("labels"))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sequences", "split", "label").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def _logits():
    return F.array(F.lit(0.0), (F.col("value") - 100) / 50)


def score_events(spark: SparkSession, d: str) -> DataFrame:
    return with_predictions(table(spark, d, "events", "event_id", "value").withColumn("logits", _logits()), "logits").drop("value").withColumn("prob_abnormal", F.round(F.col("prob_abnormal").cast("double"), 5))


def class_slice(spark: SparkSession, d: str) -> DataFrame:
    p = softmax(_logits())
    return table(spark, d, "events", "event_id", "value").select("event_id", argmax(p).alias("pred"), F.round(F.get(p, F.lit(0)).cast("double"), 5).alias("p0"), F.round(F.get(p, F.lit(1)).cast("double"), 5).alias("p1"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").distinct()


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


def metrics_all(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(binary_metrics(_predictions(spark, d)))


def metrics_by_run(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(binary_metrics(_predictions(spark, d), by=("run_id",)))


def score_health(spark: SparkSession, d: str) -> DataFrame:
    return bad_scores(_predictions(spark, d), by=("run_id",))


def stop_rule(spark: SparkSession, d: str) -> DataFrame:
    return early_stopping(table(spark, d, "epoch_history"))


def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    return best_epochs(table(spark, d, "epoch_history"))


def best_before_stop(spark: SparkSession, d: str) -> DataFrame:
    return best_epochs(table(spark, d, "epoch_history"), patience=2)


def token_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sequences", "seq_id", "text").where("text is not null").select("seq_id", F.size(words(F.col("text"))).alias("tokens"))


def whitespace_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sequences", "seq_id", "text").where("text is not null").select("seq_id", F.size(whitespace_words(F.col("text"))).alias("n"))


def truncate_pad(spark: SparkSession, d: str) -> DataFrame:
    tokens = truncated(whitespace_words(F.coalesce("text", F.lit(""))), 16, "[CLS]", "[SEP]")
    return table(spark, d, "sequences", "seq_id", "text").select("seq_id", F.array_join(padded(tokens, 16, "[PAD]"), " ").alias("padded"))


def attention_mask(spark: SparkSession, d: str) -> DataFrame:
    lengths = F.size(words(F.coalesce("text", F.lit(""))))
    ids = padded(truncated(F.array_repeat(F.lit(7), lengths), 64), 64)
    return table(spark, d, "sequences", "seq_id", "text").select("seq_id", F.aggregate(mask(ids), F.lit(0), lambda a, x: a + x).alias("ones"), F.size(ids).alias("length"))


def token_records(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_text(spark, d).select("seq_id", encoded(F.col("text"), 256, 256).alias("input_ids"), F.col("label").alias("labels"))
    return rows.select("seq_id", "input_ids", mask(F.col("input_ids")).alias("attention_mask"), "labels")


def token_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The shape of ``token_records``: length, tokens and padding of every record."""
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    pads = F.size(F.filter("input_ids", lambda x: x == 0))
    return token_records(spark, d).select("seq_id", F.size("input_ids").alias("length"), ones.alias("ones"), pads.alias("pads"), F.get("input_ids", F.lit(0)).alias("first"), F.get("input_ids", ones - 1).alias("last"), "labels")


def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The words that a WordPiece vocabulary is applied to."""
    return table(spark, d, "sequences", "seq_id", "text").where("text is not null").select("seq_id", F.array_join(basic_tokens(F.col("text")), " ").alias("tokens"))


def label_cast(spark: SparkSession, d: str) -> DataFrame:
    """``labelled`` of labels as strings, as a CSV file holds them."""
    rows = table(spark, d, "sequences", "seq_id", "text", "label", "split").withColumn("label", F.concat(F.lit(" "), F.col("label").cast("string"), F.lit(" ")))
    return labelled(rows, drop_null=True)


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return latest_delivery(table(spark, d, "bridge_steps", "step_id", "seq_id", "seq", "op", "attrs", "arrived_at"))


def render_steps(spark: SparkSession, d: str) -> DataFrame:
    return render(_steps(spark, d))


def parse_steps(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(table(spark, d, "sequences", "seq_id", "text"), "seq_id", "text").select("seq_id", "seq", "op", F.size("fields").alias("fields"))


def parsed_attrs(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "sequences", "seq_id", "text").select("seq_id", F.inline(parsed(F.col("text"))))
    return steps.select("seq_id", "seq", "op", F.explode("attrs").alias("key", "value"))


def leg_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return legs(_steps(spark, d))


def link_integrity(spark: SparkSession, d: str) -> DataFrame:
    return broken_links(_steps(spark, d))


def review_top(spark: SparkSession, d: str) -> DataFrame:
    return review_queue(_predictions(spark, d).where("run_id = 1").groupBy("seq_id").agg(F.max("prob_abnormal").alias("prob_abnormal")), "seq_id").withColumn("prob_abnormal", F.round(F.col("prob_abnormal").cast("double"), 5))


def train_predict(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_text(spark, d)
    model, _ = fit(rows.where("split = 'train'"), rows.where("split = 'validation'"), flags=True)
    return scored(model, rows.where("split = 'test'"))


def train_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_text(spark, d)
    model, history = fit(rows.where("split = 'train'"), rows.where("split = 'validation'"), flags=True)
    last = evaluate(model, rows.where("split = 'test'")).asDict()
    return spark.createDataFrame([(h["epoch"], float(h["f1"]), float(last["f1"])) for h in history], "epoch int, f1 double, test_f1 double")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p5_found, p5_rows, p5_recovered, labelled_text, split_selection, label_counts, score_events, class_slice, metrics_all, metrics_by_run, score_health, stop_rule, best_epoch, best_before_stop,
        token_count, whitespace_count, truncate_pad, attention_mask, token_records, token_lengths, word_tokens, label_cast, render_steps, parse_steps, parsed_attrs, leg_mismatch, link_integrity, review_top, train_predict, train_metrics,
    )
}

_TRIM = r"' ' || chr(9) || chr(13) || chr(10)"
_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_P5 = f"""
  WITH heads AS (SELECT file_id, string_split(min(header), ',') AS names FROM raw_files GROUP BY file_id),
  found AS (SELECT line_id, raw, names, regexp_extract_all(raw || ',', '{_FIELD},', 1) AS fields FROM raw_lines LEFT JOIN heads USING (file_id)),
  named AS (SELECT line_id, raw, names, fields,
      fields[list_position(list_transform(names, lambda x: trim(x, {_TRIM})), 'text')] AS t, fields[list_position(list_transform(names, lambda x: trim(x, {_TRIM})), 'label')] AS l FROM found),
  bare AS (SELECT line_id, raw, names, fields,
      CASE WHEN starts_with(t, '"') THEN replace(t[2:-2], '""', '"') ELSE t END AS text,
      CASE WHEN starts_with(l, '"') THEN replace(l[2:-2], '""', '"') ELSE l END AS label FROM named)
  SELECT line_id, text, label, CASE WHEN raw IS NULL OR trim(raw, {_TRIM}) = '' THEN 'columns'
      WHEN NOT regexp_full_match(raw, '{_FIELD}(,{_FIELD})*') THEN 'quoting'
      WHEN names IS NULL OR len(fields) <> len(names) THEN 'columns'
      WHEN lower(trim(text, {_TRIM})) IN ('', 'na', 'nan', 'null', 'none') THEN 'text'
      WHEN trim(label, {_TRIM}) NOT IN ('0', '1') THEN 'label' END AS reason FROM bare"""

_EVENT_P = "SELECT event_id, 1 / (1 + exp((value - 100) / 50)) AS p0, 1 / (1 + exp(-(value - 100) / 50)) AS p1 FROM events"
_PREDICTIONS = "(SELECT DISTINCT * FROM predictions)"


def _metrics(by: str = "") -> str:
    """SQL of the binary metrics."""
    return f"""
  SELECT {by} tp, fp, fn, support, coalesce(round(correct / nullif(support, 0), 9), 0) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0), 9), 0) AS "precision",
    coalesce(round(tp / nullif(tp + fn, 0), 9), 0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 9), 0) AS f1
  FROM (SELECT {by} count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label <> 1 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred <> 1) AS fn,
      count(*) FILTER (label = pred) AS correct, count(*) AS support
    FROM {_PREDICTIONS} WHERE label IS NOT NULL AND pred IS NOT NULL {'GROUP BY ' + by.strip(', ') if by else ''})"""


_STOP = """
  SELECT run_id, epoch, f1, last_best, epoch - coalesce(last_best, first - 1) >= 2 AS stop FROM (
    SELECT run_id, epoch, f1, first, max(CASE WHEN gained THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS last_best FROM (
      SELECT run_id, epoch, f1, min(epoch) OVER (PARTITION BY run_id) AS first, f1 IS NOT NULL AND (prev IS NULL OR f1 > prev) AS gained FROM (
        SELECT run_id, epoch, f1, max(f1) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM epoch_history)))"""
_BEST = "SELECT run_id, epoch, f1 FROM (SELECT run_id, epoch, f1, row_number() OVER (PARTITION BY run_id ORDER BY f1 DESC, epoch) AS r FROM {source} WHERE f1 IS NOT NULL) WHERE r = 1"
_STEPS = "(SELECT step_id, seq_id, seq, op, attrs FROM (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY arrived_at DESC NULLS LAST) AS r FROM bridge_steps) WHERE r = 1)"
_LEGS = """
  SELECT *, first_to <> last_to OR first_amount <> last_amount AS mismatch FROM (
    SELECT seq_id, max(attrs['to']) FILTER (upper(op) IN ('LOCK', 'SRC')) AS first_to, max(attrs['to']) FILTER (upper(op) IN ('UNLOCK', 'DST')) AS last_to,
      max(attrs['amount']) FILTER (upper(op) IN ('LOCK', 'SRC')) AS first_amount, max(attrs['amount']) FILTER (upper(op) IN ('UNLOCK', 'DST')) AS last_amount
    FROM {steps} WHERE seq_id IS NOT NULL GROUP BY seq_id)"""
_LINKS = " UNION ALL ".join(f"SELECT seq_id, seq, upper(op) AS op, '{f}' AS field, attrs['{f}'] AS value FROM {_STEPS} WHERE attrs['{f}'] IS NOT NULL" for f in ("ref_lock", "ref_deposit", "ref_parse", "ref_auth", "src_tx"))
_TARGETS = " UNION ALL ".join(f"SELECT seq_id, '{f}' AS field, attrs['{k}'] AS value FROM {_STEPS} WHERE upper(op) = '{o}' AND attrs['{k}'] IS NOT NULL" for f, k, o in (("ref_lock", "tx", "LOCK"), ("ref_deposit", "tx", "DEPOSIT"), ("ref_parse", "id", "PARSE"), ("ref_auth", "id", "AUTHORIZE"), ("src_tx", "tx", "SRC")))
_TOKENS = r"len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'))"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\x0b\f\r ]+'), lambda x: x <> '')"
_PIECES = r"""(
  WITH plain AS (SELECT seq_id, string_split(translate(regexp_replace(text, '\p{Cf}+', '', 'g'), '；＝', ';='), ';') AS pieces FROM sequences WHERE text IS NOT NULL),
  rows AS (SELECT seq_id, unnest(range(1, len(pieces) + 1)) AS seq, unnest(pieces) AS piece FROM plain)
  SELECT seq_id, seq, list_filter(regexp_split_to_array(piece, '[\s\x0b\x{85}\p{Z}]+'), lambda x: x <> '') AS words FROM rows)"""
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\p{Cf}\p{Co}]"
_MARKS = "\\p{P}" + SYMBOLS.replace("^", "\\^")
_CJK = re.sub(r"[^-]", lambda m: f"\\x{{{ord(m[0]):x}}}", IDEOGRAPHS)

SQL: dict[str, str] = {
    "labelled_text": "SELECT seq_id, text, label, split FROM sequences WHERE text IS NOT NULL AND label IS NOT NULL",
    "split_selection": "SELECT seq_id, label AS labels FROM sequences WHERE split = 'validation'",
    "label_counts": "SELECT split, label, count(*) AS n FROM sequences GROUP BY split, label",
    "score_events": f"SELECT event_id, CASE WHEN p1 > p0 THEN 1 WHEN p0 >= p1 THEN 0 END AS pred, round(CAST(CAST(p1 AS FLOAT) AS DOUBLE), 5) AS prob_abnormal FROM ({_EVENT_P})",
    "class_slice": f"SELECT event_id, CASE WHEN p1 > p0 THEN 1 WHEN p0 >= p1 THEN 0 END AS pred, round(CAST(CAST(p0 AS FLOAT) AS DOUBLE), 5) AS p0, round(CAST(CAST(p1 AS FLOAT) AS DOUBLE), 5) AS p1 FROM ({_EVENT_P})",
    "metrics_all": _metrics(),
    "metrics_by_run": _metrics("run_id,"),
    "score_health": f"SELECT run_id, count(*) AS scored, count(*) FILTER (prob_abnormal IS NULL) AS null_scores, count(*) FILTER (isnan(prob_abnormal)) AS nan_scores FROM {_PREDICTIONS} GROUP BY run_id",
    "stop_rule": _STOP,
    "best_epoch": _BEST.format(source="epoch_history"),
    "best_before_stop": f"WITH s AS ({_STOP}), u AS (SELECT run_id, min(epoch) AS until FROM s WHERE stop GROUP BY run_id), k AS (SELECT s.* FROM s LEFT JOIN u USING (run_id) WHERE until IS NULL OR epoch <= until) " + _BEST.format(source="k"),
    "token_count": f"SELECT seq_id, CAST({_TOKENS} AS INT) AS tokens FROM sequences WHERE text IS NOT NULL",
    "whitespace_count": f"SELECT seq_id, CAST(len({_WORDS}) AS INT) AS n FROM sequences WHERE text IS NOT NULL",
    "truncate_pad": f"SELECT seq_id, array_to_string(list_concat(['[CLS]'], ({_WORDS})[1:14], ['[SEP]'], list_transform(range(14 - least(len({_WORDS}), 14)), lambda x: '[PAD]')), ' ') AS padded FROM sequences",
    "attention_mask": f"SELECT seq_id, CAST(least({_TOKENS} + 2, 64) AS INT) AS ones, CAST(64 AS INT) AS length FROM sequences",
    "render_steps": f"""
      SELECT seq_id, string_agg(step, '; ' ORDER BY seq, step_id) AS text FROM (
        SELECT seq_id, seq, step_id, rtrim(upper(op) || ' ' || coalesce(array_to_string(list_transform(list_filter(list_sort(map_entries(attrs)), lambda e: e.value IS NOT NULL), lambda e: e.key || '=' || e.value), ' '), '')) AS step
        FROM {_STEPS} WHERE seq_id IS NOT NULL) GROUP BY seq_id""",
    "parse_steps": f"SELECT seq_id, CAST(seq AS INT) AS seq, words[1] AS op, CAST(len(words) - 1 AS INT) AS fields FROM {_PIECES} WHERE len(words) > 0",
    "parsed_attrs": f"""
      SELECT seq_id, CAST(seq AS INT) AS seq, op, split_part(word, '=', 1) AS key, arg_max(substr(word, strpos(word, '=') + 1), i) AS value FROM (
        SELECT seq_id, seq, words[1] AS op, unnest(words[2:]) AS word, unnest(range(len(words) - 1)) AS i FROM {_PIECES} WHERE len(words) > 0)
      WHERE contains(word, '=') GROUP BY ALL""",
    "token_lengths": f"SELECT seq_id, CAST(256 AS INT) AS length, CAST(least({_TOKENS} + 2, 256) AS INT) AS ones, CAST(256 - least({_TOKENS} + 2, 256) AS INT) AS pads, CAST(101 AS INT) AS first, CAST(102 AS INT) AS last, label AS labels FROM sequences WHERE text IS NOT NULL AND label IS NOT NULL",
    "word_tokens": f"SELECT seq_id, array_to_string(regexp_extract_all(strip_accents(lower(regexp_replace(text, '{_CONTROL}', '', 'g'))), '[{_CJK}]|[{_MARKS}]|[^\\s\\x0b\\x{{85}}\\p{{Z}}{_MARKS}{_CJK}]+'), ' ') AS tokens FROM sequences WHERE text IS NOT NULL",
    "label_cast": "SELECT seq_id, text, label, split FROM sequences WHERE text IS NOT NULL AND label IS NOT NULL",
    "leg_mismatch": _LEGS.format(steps=_STEPS),
    "link_integrity": f"SELECT DISTINCT r.* FROM ({_LINKS}) r WHERE NOT EXISTS (SELECT 1 FROM ({_TARGETS}) t WHERE t.seq_id = r.seq_id AND t.field = r.field AND t.value = r.value)",
    "review_top": f"SELECT seq_id, round(CAST(p AS DOUBLE), 5) AS prob_abnormal FROM (SELECT seq_id, max(prob_abnormal) AS p FROM {_PREDICTIONS} WHERE run_id = 1 GROUP BY seq_id) WHERE p IS NOT NULL AND NOT isnan(p) AND p >= 0.5 ORDER BY p DESC, seq_id LIMIT 25",
    "p5_found": f"SELECT DISTINCT line_id, reason FROM ({_P5}) WHERE reason IS NOT NULL",
    "p5_rows": f"SELECT line_id, text, CAST(trim(label, {_TRIM}) AS BIGINT) AS label FROM ({_P5}) WHERE reason IS NULL",
}
