"""The pN_ queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.bpe import encode_corpus
from seqloom.llm.copies import KEYS, OPS, Copies
from seqloom.llm.crosssplit import CrossSplit, found_pairs, report, split_side
from seqloom.llm.leakage import cleaned, leaks
from seqloom.llm.nearcopies import NearCopies
from seqloom.llm.sampling import sample, supply, unmet
from seqloom.llm.templates import by_evidence, residue, without_residue
from seqloom.llm.terms import marked_terms
from seqloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return Copies(table(spark, d, "sequences"), "seq_id", "text").pairs()


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return Copies(table(spark, d, "sequences"), "seq_id", "text").records().withColumnRenamed("id", "seq_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return marked_terms(table(spark, d, "sequences"), "seq_id", "text").where("mark is not null").select("term", "mark")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return marked_terms(table(spark, d, "sequences"), "seq_id", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return unmet(table(spark, d, "sequences"), table(spark, d, "label_targets")).select("plan_id", "source", "label").distinct()


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample(table(spark, d, "sequences"), table(spark, d, "label_targets"), "seq_id").withColumnRenamed("id", "seq_id")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    drawn = sample(table(spark, d, "sequences"), table(spark, d, "label_targets"), "seq_id")
    return drawn.groupBy("plan_id", "split", "source", "label").agg(F.count(F.lit(1)).alias("sampled"))


def p3_supply(spark: SparkSession, d: str) -> DataFrame:
    return supply(table(spark, d, "sequences"), table(spark, d, "label_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return NearCopies(table(spark, d, "sequences"), "seq_id", "text").pairs()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    found = NearCopies(table(spark, d, "sequences"), "seq_id", "text").groups()
    return found.select(F.col("id").alias("seq_id"), F.col("cls").alias("class_id"), F.col("grp").alias("group_id"), "links")


def p4_filters(spark: SparkSession, d: str) -> DataFrame:
    return NearCopies(table(spark, d, "sequences"), "seq_id", "text").filtered()


def _across(spark: SparkSession, d: str) -> CrossSplit:
    return CrossSplit(table(spark, d, "sequences"), "seq_id", "text", split_side(F.col("split")), 0.0, jaccard=0.8)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return found_pairs(_across(spark, d).overlaps())


def p6_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Classes of equal word sets whose vectors of inverse frequencies are similar."""
    cross = CrossSplit(table(spark, d, "sequences"), "seq_id", "text", split_side(F.col("split")), 0.9, scheme="idf")
    return cross.links.select(F.col("a").alias("train_class"), F.col("b").alias("held_class"), F.round("cosine", 2).alias("cosine"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return report(_across(spark, d), table(spark, d, "sequences"), "seq_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "item_id").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return cleaned(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "item_id").withColumnRenamed("doc", "doc_id")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return p8_clean(spark, d).where("spans > 0").select("doc_id", "spans")


SLUG = ("bridge", "doc_kind")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "documents"), "doc_id", "text", "source", SLUG).select(F.col("id").alias("doc_id")).distinct()


def p9_evidence(spark: SparkSession, d: str) -> DataFrame:
    return by_evidence(residue(table(spark, d, "documents"), "doc_id", "text", "source", SLUG))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_residue(table(spark, d, "documents"), "doc_id", "text", "source", SLUG).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_terms, p3_found, p3_sample, p3_counts, p3_supply, p4_found, p4_groups, p4_filters, p6_found, p6_report, p6_weighted, p7_ids, p8_found, p8_clean, p8_spans, p9_found, p9_evidence, p9_clean)}

_WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
_TERMS = f"""
  WITH rows AS (SELECT seq_id, text FROM sequences WHERE text IS NOT NULL),
  words AS (SELECT seq_id, lower(unnest({_WORDS})) AS term FROM rows)
  SELECT term, count(DISTINCT seq_id) AS records, count(*) AS occurrences,
    CASE WHEN count(DISTINCT seq_id) < 3 THEN 'rare'
         WHEN count(DISTINCT seq_id) > 0.3 * (SELECT count(*) FROM rows) THEN 'common' END AS mark
  FROM words GROUP BY term"""
_SUPPLY = """
  SELECT t.plan_id, t.split, t.source, t.label, t.wanted,
    count(s.seq_id) AS have, CAST(greatest(t.wanted - count(s.seq_id), 0) AS BIGINT) AS deficit
  FROM (SELECT plan_id, split, source, label, max(greatest(CAST(round(target_share * sample_rows) AS BIGINT), min_rows)) AS wanted
        FROM label_targets GROUP BY ALL) t
  LEFT JOIN sequences s ON s.split IS NOT DISTINCT FROM t.split AND s.source IS NOT DISTINCT FROM t.source AND s.label IS NOT DISTINCT FROM t.label
  GROUP BY t.plan_id, t.split, t.source, t.label, t.wanted"""
_GRAMS = """(SELECT {id}, unnest(list_transform(range(1, greatest(len(w) - 8, 1)), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
  FROM (SELECT {id}, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)) AS w FROM {table}))"""
_P8 = f"SELECT DISTINCT a.doc_id, b.item_id FROM {_GRAMS.format(id='doc_id', table='documents')} a JOIN {_GRAMS.format(id='item_id', table='eval_items')} b ON a.g = b.g"
_P8_SPANS = """
  WITH doc_words AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: lower(x)) AS w FROM documents),
  item_words AS (SELECT list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: lower(x)) AS w FROM eval_items),
  grams AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w) - 8, 1)), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM item_words),
  places AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 8, 1))) AS i, w FROM doc_words),
  met AS (SELECT doc_id, i FROM places JOIN grams ON g = array_to_string(w[i:i + 9], ' '))
  SELECT doc_id, CAST(count(*) AS INT) AS spans FROM (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM met) WHERE step IS NULL OR step >= 10 GROUP BY doc_id"""

_OPS = "'" + "', '".join(sorted(OPS)) + "'"
_KEYS = "'" + "', '".join(sorted(KEYS)) + "'"
_HIDDEN = r"[\p{Cf}\x{FE00}-\x{FE0F}]"
_GROUPED = r"'([0-9])[,''\x{2019}\x{00a0}\x{2009}\x{202f}]([0-9]{3})([^0-9]|$)', '\1\2\3', 'g'"
_CANON = f"""
  WITH plain AS (SELECT seq_id, regexp_replace(lower(text), '{_HIDDEN}', '', 'g') AS t FROM sequences WHERE text IS NOT NULL),
  joined AS (SELECT seq_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {_GROUPED}), {_GROUPED}), {_GROUPED}), '([0-9])[.]([0-9])', '\\1_dot_\\2', 'g') AS t FROM plain),
  lists AS (SELECT seq_id, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+') AS w FROM joined),
  tokens AS (SELECT seq_id, unnest(w) AS w, unnest(range(len(w))) AS pos FROM lists),
  marked AS (SELECT *, sum(CASE WHEN w IN ({_OPS}) THEN 1 ELSE 0 END) OVER p AS step, sum(CASE WHEN w IN ({_OPS}, {_KEYS}) THEN 1 ELSE 0 END) OVER p AS field FROM tokens WINDOW p AS (PARTITION BY seq_id ORDER BY pos)),
  fields AS (SELECT seq_id, step, field, string_agg(w, ' ' ORDER BY pos) AS v, bool_or(w IN ({_OPS})) AS op FROM marked GROUP BY seq_id, step, field),
  steps AS (SELECT seq_id, step, string_agg(v, '|' ORDER BY NOT op, v) AS v FROM fields GROUP BY seq_id, step),
  canon AS (SELECT seq_id, string_agg(v, '#' ORDER BY step) AS c FROM steps GROUP BY seq_id)"""
_SIMILAR = r"""
  WITH plain AS (SELECT seq_id, regexp_replace(regexp_replace(regexp_replace(text, G), G), G) AS t FROM sequences WHERE text IS NOT NULL),
  words AS (SELECT DISTINCT seq_id, lower(unnest(regexp_extract_all(t, '[\p{L}\p{N}_]+'))) AS w FROM plain),
  sizes AS (SELECT seq_id, count(*) AS n FROM words GROUP BY seq_id),
  sized AS (SELECT w.seq_id, w, n FROM words w JOIN sizes s ON s.seq_id = w.seq_id),
  pairs AS (SELECT a.seq_id AS id_a, b.seq_id AS id_b FROM sized a JOIN sized b ON a.w = b.w AND a.seq_id < b.seq_id AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4
    GROUP BY a.seq_id, b.seq_id, a.n, b.n HAVING count(*) * 9 >= (a.n + b.n) * 4)""".replace("G)", r"'([0-9])[,'']([0-9]{3})([^0-9]|$)', '\1\2\3', 'g')")
_CROSS = "(SELECT id_a, id_b FROM pairs JOIN sequences x ON x.seq_id = id_a JOIN sequences y ON y.seq_id = id_b WHERE (x.split = 'train' AND y.split IN ('validation', 'test')) OR (y.split = 'train' AND x.split IN ('validation', 'test')))"
_WORDSETS = _SIMILAR.split("sizes AS")[0]
_WEIGHTED = (
    _WORDSETS
    + """
  sides AS (SELECT seq_id, CASE WHEN split = 'train' THEN 1 WHEN split IN ('validation', 'test') THEN 2 END AS side FROM sequences),
  sets AS (SELECT seq_id, side, list_sort(list(w)) AS s FROM words JOIN sides USING (seq_id) WHERE side IS NOT NULL GROUP BY seq_id, side),
  classes AS (SELECT min(seq_id) AS rep, bit_or(side) AS side, s FROM sets GROUP BY s),
  entries AS (SELECT rep, side, unnest(s) AS w FROM classes),
  weights AS (SELECT w, ln(1 + (SELECT count(*) FROM classes) / count(*)) AS x FROM entries GROUP BY w),
  vectors AS (SELECT rep, side, w, x FROM entries JOIN weights USING (w)),
  norms AS (SELECT rep, sqrt(sum(x * x)) AS norm FROM vectors GROUP BY rep),
  dots AS (SELECT a.rep AS a, b.rep AS b, sum(a.x * b.x) AS dot FROM vectors a JOIN vectors b ON a.w = b.w AND a.rep <> b.rep AND a.side & 1 = 1 AND b.side & 2 = 2 GROUP BY a.rep, b.rep)
  SELECT a AS train_class, b AS held_class, round(dot / (n.norm * m.norm), 2) AS cosine FROM dots JOIN norms n ON n.rep = a JOIN norms m ON m.rep = b WHERE dot / (n.norm * m.norm) >= 0.9 - 1e-9"""
)
_GROUPED_ROWS = (
    _SIMILAR.replace("WITH plain", "WITH RECURSIVE plain", 1)
    + """,
  sets AS (SELECT seq_id, list_sort(list(w)) AS s FROM words GROUP BY seq_id),
  classed AS (SELECT seq_id, min(seq_id) OVER (PARTITION BY s) AS class_id FROM sets),
  edges AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
  reach AS (SELECT seq_id AS id, seq_id AS other FROM sets UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
  grouped AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id),
  linked AS (SELECT a, count(*) AS links FROM edges GROUP BY a)
  SELECT c.seq_id, class_id, group_id, CAST(coalesce(links, 0) AS BIGINT) AS links FROM classed c JOIN grouped g ON g.id = c.seq_id LEFT JOIN linked l ON l.a = c.seq_id"""
)

SQL: dict[str, str] = {
    "p8_found": _P8,
    "p8_spans": _P8_SPANS,
    "p1_found": _CANON + " SELECT m AS id_a, seq_id AS id_b FROM (SELECT seq_id, min(seq_id) OVER (PARTITION BY c) AS m FROM canon) WHERE m <> seq_id",
    "p1_records": _CANON + " SELECT min(seq_id) AS seq_id, count(*) AS copies FROM canon GROUP BY c UNION ALL SELECT seq_id, 1 FROM sequences WHERE seq_id NOT IN (SELECT seq_id FROM canon)",
    "p4_found": _SIMILAR + " SELECT id_a, id_b FROM pairs",
    "p6_found": _SIMILAR + f" SELECT id_a, id_b FROM {_CROSS}",
    "p6_report": _SIMILAR + f" SELECT h.split, h.source, count(*) AS pairs, count(DISTINCT h.seq_id) AS held_rows, count(*) FILTER (h.label = t.label) AS same_label FROM {_CROSS} p JOIN sequences h ON h.seq_id IN (id_a, id_b) AND h.split <> 'train' JOIN sequences t ON t.seq_id IN (id_a, id_b) AND t.split = 'train' GROUP BY h.split, h.source",
    "p4_groups": _GROUPED_ROWS,
    "p6_weighted": _WEIGHTED,
    "p2_terms": _TERMS,
    "p2_found": f"SELECT term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p3_supply": _SUPPLY,
    "p3_counts": f"SELECT plan_id, split, source, label, least(wanted, have) AS sampled FROM ({_SUPPLY}) WHERE wanted > 0 AND have > 0",
    "p3_found": f"SELECT DISTINCT plan_id, source, label FROM ({_SUPPLY}) WHERE deficit > 0",
}
