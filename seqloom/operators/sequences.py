"""Event sequences as text: rendering, parsing, consistency of steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_delivery(steps: DataFrame, key: str = "step_id", arrived: str = "arrived_at") -> DataFrame:
    """One row a step: of several deliveries the last to arrive. A step without arrival
    time loses to any other; steps with a null key are all kept."""
    columns = [c for c in steps.columns if c != key]
    order = F.struct(F.col(arrived).isNotNull(), F.col(arrived), F.xxhash64(*[F.col(c) for c in columns if not steps.schema[c].dataType.typeName() == "map"]))
    row = F.max_by(F.struct(*columns), order).alias("row")
    keyed = steps.where(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, "row.*").select(*steps.columns)
    return keyed.unionByName(steps.where(F.col(key).isNull()))


def rendered_step(op: Column, attrs: Column) -> Column:
    """``OP key=value …`` with the keys in order; null values are left out."""
    entries = F.array_sort(F.map_entries(F.coalesce(attrs, F.create_map().cast("map<string,string>"))))
    fields = F.transform(F.filter(entries, lambda e: e["value"].isNotNull()), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(" ", F.upper(op), F.array_join(fields, " "))


def render(steps: DataFrame, sequence: str = "seq_id", order: tuple[str, ...] = ("seq", "step_id")) -> DataFrame:
    """(sequence, text): each sequence's steps in order, joined by ``; ``. A sequence is
    as long as its steps, so a group fits in a row; rows of no sequence are left out."""
    row = F.struct(*order, F.rtrim(rendered_step(F.col("op"), F.col("attrs"))).alias("step"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["step"]), "; ")
    return steps.where(F.col(sequence).isNotNull()).groupBy(sequence).agg(joined.alias("text"))


#: What counts as white space, and the full-width separators.
_SPACE = r"[\s\x{85}\p{Z}]+"


def _plain(text: Column) -> Column:
    """The text without invisible characters, with ASCII separators."""
    return F.translate(F.regexp_replace(text, r"\p{Cf}+", ""), "；＝", ";=")


def _rest(words: Column) -> Column:
    """All words but the first."""
    return F.slice(words, F.lit(2), F.size(words))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _attrs(words: Column) -> Column:
    """The map of ``key=value`` words; of a key that comes twice the last value counts."""

    def pair(word: Column) -> Column:
        return _let(F.substring_index(word, "=", 1), lambda key: F.struct(key.alias("key"), F.substr(word, F.length(key) + 2).alias("value")))

    def mapped(pairs: Column) -> Column:
        keys = F.array_distinct(pairs["key"])
        last = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))
        return F.when(F.size(keys) == F.size(pairs), F.map_from_entries(pairs)).otherwise(last)

    return _let(F.transform(F.filter(words, lambda p: p.contains("=")), pair), mapped)


def parsed(text: Column) -> Column:
    """array<struct<seq, op, attrs>> of ``OP key=value …; OP …``; null for null. Of a key
    that a step repeats, the last value counts."""
    trimmed = lambda s: F.regexp_replace(s, f"^{_SPACE}|{_SPACE}$", "")
    words = F.transform(F.split(_plain(text), ";"), lambda s: F.split(trimmed(s), _SPACE))
    return F.transform(words, lambda w, i: F.struct((i + 1).cast("int").alias("seq"), F.get(w, F.lit(0)).alias("op"), _attrs(_rest(w)).alias("attrs")))


def steps_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, seq, op, fields): one row a step of each text, fields as ``key=value`` words.
    Invisible characters are dropped, white space and separators of any script count."""
    pieces = F.posexplode(F.split(_plain(F.col(text_col)), ";"))
    rows = df.where(F.col(text_col).isNotNull()).select(id_col, pieces.alias("pos", "piece"))
    words = F.filter(F.split("piece", _SPACE), lambda x: x != "")
    return rows.select(id_col, (F.col("pos") + 1).cast("int").alias("seq"), words.alias("words")).where(F.size("words") > 0).select(id_col, "seq", F.element_at("words", 1).alias("op"), _rest(F.col("words")).alias("fields"))


#: First and last legs of both families of transfers.
FIRST_LEGS, LAST_LEGS = ("LOCK", "SRC"), ("UNLOCK", "DST")


def legs(steps: DataFrame, sequence: str = "seq_id") -> DataFrame:
    """(sequence, first_to, last_to, first_amount, last_amount, mismatch): recipient and
    amount of the first and the last leg, and whether they differ; unknown if a leg
    lacks a value."""
    op = F.upper("op")
    value = lambda ops, key: F.max(F.when(op.isin(*ops), F.col("attrs")[key]))
    rows = steps.where(F.col(sequence).isNotNull()).groupBy(sequence).agg(value(FIRST_LEGS, "to").alias("first_to"), value(LAST_LEGS, "to").alias("last_to"), value(FIRST_LEGS, "amount").alias("first_amount"), value(LAST_LEGS, "amount").alias("last_amount"))
    return rows.withColumn("mismatch", (F.col("first_to") != F.col("last_to")) | (F.col("first_amount") != F.col("last_amount")))


#: Reference field → the field and op it points to.
LINKS = {"ref_lock": ("tx", "LOCK"), "ref_deposit": ("tx", "DEPOSIT"), "ref_parse": ("id", "PARSE"), "ref_auth": ("id", "AUTHORIZE"), "src_tx": ("tx", "SRC")}


def broken_links(steps: DataFrame, sequence: str = "seq_id") -> DataFrame:
    """(sequence, seq, op, field, value) of references that no step of the sequence has.

    References meet their targets by sequence, field and value, so a long sequence is
    spread over tasks like any other rows."""
    op = F.upper("op")
    rows = steps.where(F.col(sequence).isNotNull() & F.col("attrs").isNotNull())
    targets = F.array(*[F.struct(F.lit(field).alias("field"), F.when(op == want, F.col("attrs")[key]).alias("value")) for field, (key, want) in LINKS.items()])
    references = F.array(*[F.struct(F.lit(field).alias("field"), F.col("attrs")[field].alias("value")) for field in LINKS])
    held = lambda pairs: F.inline(F.filter(pairs, lambda x: x["value"].isNotNull()))
    refs = rows.select(sequence, "seq", op.alias("op"), held(references)).distinct()
    known = rows.select(sequence, held(targets)).distinct()
    return refs.join(known, [sequence, "field", "value"], "left_anti").select(sequence, "seq", "op", "field", "value")


def review_queue(scored: DataFrame, key: str, prob: str = "prob_abnormal", threshold: float = 0.5, limit: int = 25) -> DataFrame:
    """The rows to review first: scores from ``threshold`` on, highest first, ties by key.
    Null and NaN scores are no scores. Each task keeps its top rows only."""
    return scored.where(F.col(prob).isNotNull() & ~F.isnan(prob) & (F.col(prob) >= threshold)).orderBy(F.desc(prob), F.asc(key)).limit(limit)
