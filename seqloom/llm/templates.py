"""Problem 9: template residue and error-page text.

Each document's address slug (site, bridge and whatever columns name it), its title and
its body are compared, sentence by sentence, for every document. A sentence is of low
information if it is short and names nothing: no number, no handle, no name. It is
mismatched if none of its terms stands in slug, title or any other sentence of the
document. The detectors of ``residue`` decide which sentences look like residue by
themselves, and which places hold a placeholder where a value should stand.

Sentences become shapes, in which names, numbers and placeholders are replaced, and the
shapes are counted over the whole corpus, by document and by host:

- A response is a shape of low information that several documents of several hosts
  repeat and that is mismatched in four of five of them. It flags a document if it is the
  whole body, beside others of its sort, on several hosts and in one of five documents,
  whatever the detectors say, or if they flag four of five documents that hold it.
- A slot is the place of a placeholder or of the mark of a missing value in a shape that
  documents of several hosts fill with names and numbers. A mark that its sentence seems
  to discuss is residue if its place is a slot.
- A whole body is flagged if its shape comes from several documents of several hosts and
  the detectors flag half of these, or all are shells: page furniture of few terms.

Repetition alone flags nothing: reports repeat, too.

Results for odd input: null, empty and blank texts are never flagged; null slug
columns count as empty, a null host as a host of its own; rows with equal or null
identifiers are judged one by one; an empty table gives an empty result. Only the
named columns are read, whatever others exist.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm import residue as R
from seqloom.plans.shared import checked_broadcast, materialize, rows_up_to, spread

#: Lines that carry no content of their own: navigation, references, waiting notes.
_FURNITURE = re.compile(r"(?:loading|please wait|redirecting|one moment|just a moment|bitte warten|un momento|veuillez patienter|正在加载|加载中|请稍候)\b.*|(?:request|ref|ray|trace) id.*|[45]\d\d|skip to content|back|←.*|©.*|(?:[\w ]{1,20}[|·>›]){1,8}[\w ]{1,20}|menu(?:  ?\w+){0,8}", re.I)
_TITLE = re.compile(r"#{1,6} .*|(?:subject|betreff|asunto|objet|主题) ?: .*|\S+ \d+(?:\.\d+)+", re.I)
#: A line of the head of a message, under its subject.
_HEAD = re.compile(r"[^\W\d_][\w -]{0,24} ?[:：] ?\S.*")
_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"\d")
#: Words, runs of ideographs, and the marks of replaced places.
_TERM = re.compile(r"[\x01\x02]|@?[^\W㐀-鿿]+|[㐀-鿿]+")
#: Kinds of residue that are a whole answer instead of a value inside one.
_ANSWERS = frozenset(("filler", "error", "notice"))
#: Terms between which a sentence can be of low information; two ideographs count as one.
SHORT = range(2, 17)
MISMATCHED, ANSWER = 1, 2


class Profile(NamedTuple):
    """How much the body of a text says, and how: ``shared`` of its ``terms`` different
    words stand in slug or title; ``furniture`` if its lines carry no content."""

    terms: int
    shared: int
    furniture: bool
    shape: int | None


class Judgement(NamedTuple):
    """What one text shows: ``kinds`` of the detectors, ``shape`` of its body, ``shell``
    for furniture without a hit; shapes of its sentences of ``low`` information with
    their ``bits``; ``alone`` if it has no other sentences; shapes of sentences that hold
    a placeholder or mark, a mark they seem to discuss, or only ``valued`` places."""

    kinds: list[str]
    shape: int | None
    shell: bool
    low: list[int]
    bits: list[int]
    alone: bool
    held: list[int]
    doubted: list[int]
    valued: list[int]


_NOTHING = Judgement([], None, False, [], [], False, [], [], [])


def _head(lines: list[str]) -> int:
    """Number of lines of the title, and of the head of a message under a subject."""
    if not lines or not _TITLE.fullmatch(lines[0]):
        return 0
    n = 1
    if ":" in lines[0] and lines[0][0] != "#":
        while n < len(lines) and _HEAD.fullmatch(lines[n]):
            n += 1
    return n


def _hash(shape: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(shape)) - (1 << 63)


@lru_cache(1 << 17)
def _word(word: str) -> tuple[str, int]:
    """A word in lower case and whether it names something: 0 no, 1 unless it starts a
    sentence, 2 yes."""
    if word[0] in "\x01\x02@" or _DIGIT.search(word):
        return word.lower(), 2
    return word.lower(), int(word[0].isupper() and not word.isupper())


def _shape(piece: str, known: set[str]) -> list[str]:
    """Terms of a sentence in lower case, with one mark for each run of names, numbers,
    words of slug or title, and replaced places."""
    shape: list[str] = []
    first, last = 1, ""
    for w in _TERM.findall(piece):
        low, names = _word(w)
        if names > first or low in known:
            if last != "#":
                shape.append("#")
            last = "#"
        else:
            shape.append(low)
            last = low
        first = 0
    return shape


def _terms(shape: list[str]) -> set[str]:
    """The terms by which sentences are compared: words of four letters or more, and
    pairs of ideographs."""
    found: set[str] = set()
    for w in shape:
        if "㐀" <= w[0] <= "鿿":
            found.update(w[i : i + 2] for i in range(len(w) - 1))
        elif len(w) > 3:
            found.add(w)
    return found


def _size(shape: list[str]) -> int:
    return sum((len(w) + 1) // 2 if "㐀" <= w[0] <= "鿿" else 1 for w in shape)


def _body_shape(shapes: Iterable[list[str]]) -> int | None:
    flat = [w for s in shapes for w in s]
    return _hash(flat) if any(w != "#" for w in flat) else None


def _compared(lines: list[str], known: set[str]) -> tuple[int, int]:
    """Number of different words of the lines, and of those in slug or title."""
    terms = {w.lower() for x in lines for w in _WORD.findall(x)}
    return len(terms), len(terms & known)


def _furniture(lines: list[str]) -> bool:
    return bool(lines) and all(_FURNITURE.fullmatch(x) for x in lines)


def _split(plain: str, slug: str) -> tuple[list[str], list[str], set[str]]:
    """Lines of title and body, and the words of slug and title."""
    lines = [x.strip() for x in plain.split("\n") if x.strip()]
    n = _head(lines)
    return lines[:n], lines[n:], {w.lower() for w in _WORD.findall(f"{slug} {' '.join(lines[:n])}")}


def profile(plain: str, slug: str) -> Profile:
    """The comparison of a normalised text's body with slug and title. The shape is null
    for a body of names and numbers only."""
    _, body, known = _split(plain, slug)
    return Profile(*_compared(body, known), _furniture(body), _body_shape(_shape(p, known) for p in R.pieces("\n".join(body))))


def _replaced(text: str, spans: list[tuple[int, int]], named: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for start, end, mark in sorted([(*s, "\x01") for s in spans] + [(*s, "\x02") for s in named]):
        if start >= at:
            parts += [text[at:start], mark]
            at = end
    return "".join(parts) + text[at:]


def judge(text: str | None, slug: str, least_words: int = 12) -> Judgement:
    """One text against its slug, its title and the detectors."""
    if not text:
        return _NOTHING
    plain = R.normal(text)
    own = R.own_voice(plain)
    held, marks, named = R.hits(own)
    title, body, known = _split(own, slug)
    found = R.pieces("\n".join(body))
    kind = {p: R.kind_of(" ".join(p.lower().split())) for p in dict.fromkeys(R.pieces("\n".join(title)) + found)}
    kinds = [k for k, n in (("error", R.pages(plain, own)), ("placeholder", held), ("mark", marks)) if n]
    kinds += [k for k in dict.fromkeys(kind.values()) if k and k not in kinds]
    if held or marks or named:
        found = R.pieces("\n".join(_split(_replaced(own, held + marks, named), slug)[1]))
    shapes = {p: _shape(p, known) for p in dict.fromkeys(found)}
    shell = False
    if not kinds and _furniture(body):
        terms, shared = _compared(body, known)
        shell = terms <= least_words and not shared

    low: dict[int, int] = {}
    slots: tuple[list[int], list[int], list[int]] = ([], [], [])
    plainly = []  # sentences of low information
    alone = bool(shapes)
    for piece, shape in shapes.items():
        if "\x00" in piece:
            alone = False
        elif "#" not in shape:
            if _size(shape) in SHORT:
                plainly.append((piece, shape))
            elif len(shape) > 1:
                alone = False
        elif len(shape) > 1:
            slots[0 if "\x01" in piece else 1 if "\x02" in piece else 2].append(_hash(shape))
            alone = alone and bool(_FURNITURE.fullmatch(piece))
    if plainly:
        others = Counter(t for shape in shapes.values() for t in _terms(shape))
        others.update(_terms([w.lower() for w in _TERM.findall(f"{slug} {' '.join(title)}")]))
        for piece, shape in plainly:
            terms = _terms(shape)
            mismatched = bool(terms) and all(others[t] == 1 for t in terms)
            low[_hash(shape)] = MISMATCHED * mismatched | ANSWER * bool(kind.get(piece))
    return Judgement(kinds, _body_shape(shapes.values()), shell, list(low), list(low.values()), alone, *slots)


_SCHEMA = "id long, host string, kinds array<string>, shape long, shell boolean, low array<long>, bits array<tinyint>, alone boolean, held array<long>, doubted array<long>, valued array<long>"
_TYPES = dict(kinds=pa.list_(pa.string()), shape=pa.int64(), shell=pa.bool_(), low=pa.list_(pa.int64()), bits=pa.list_(pa.int8()), alone=pa.bool_(), held=pa.list_(pa.int64()), doubted=pa.list_(pa.int64()), valued=pa.list_(pa.int64()))


def judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, slug_cols: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """The judgement of every row, written once with a row number ``uid`` and, on demand,
    the text: the texts are judged in one pass, and the counts that follow read only
    the shapes, eight bytes a sentence."""
    slug = F.concat_ws(" ", F.col(host_col).cast("string"), *[F.col(c).cast("string") for c in slug_cols])
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"), slug.alias("slug")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [judge(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("slug").to_pylist())]
            columns = [pa.array([getattr(j, name) for j in out], kind) for name, kind in _TYPES.items()]
            more = ["text"] if texts else []
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), *columns, *[b.column(c) for c in more]], ["id", "host", *_TYPES, *more])

    return materialize(rows.mapInArrow(run, _SCHEMA + (", text string" if texts else "")).withColumn("uid", F.monotonically_increasing_id()))


def _repeated(rows: DataFrame, **counts: Column) -> DataFrame:
    """(shape, docs, hosts, and of each condition NAME its documents NAME and its hosts
    NAME_hosts) of the rows' shapes, hosts counted exactly; counted by shape and host
    before the shuffle, so a hot shape is one row a task and host."""
    by_host = rows.groupBy("shape", "host").agg(F.count(F.lit(1)).alias("docs"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    return by_host.groupBy("shape").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("hosts"), *[F.sum(n).alias(n) for n in counts], *[F.count_if(F.col(n) > 0).alias(f"{n}_hosts") for n in counts])


def verdicts(rows: DataFrame, least_docs: int = 3, least_hosts: int = 2) -> DataFrame:
    """(shape, claim, decides) of all shapes with host evidence. ``claim`` is what a
    document has to show by the shape: a ``body``, a ``shell``, a ``response``, a
    ``slot``; ``decides`` if this flags a document that the detectors don't flag."""
    several = (F.col("docs") >= least_docs) & (F.col("hosts") >= least_hosts)
    answer = F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in sorted(_ANSWERS)]))
    bodies = _repeated(rows.where("shape is not null"), answers=answer, shells=F.col("shell"))
    body = bodies.where(several & (F.col("answers") * 2 >= F.col("docs"))).select("shape", F.lit("body").alias("claim"), F.lit(True).alias("decides"))
    shell = bodies.where((F.col("shells") >= least_docs) & (F.col("shells_hosts") >= least_hosts)).select("shape", F.lit("shell").alias("claim"), F.lit(True).alias("decides"))

    said = rows.select("host", "alone", (F.size("kinds") > 0).alias("flagged"), F.inline(F.arrays_zip(F.col("low").alias("shape"), F.col("bits").alias("bits"))))
    said = _repeated(said.toDF("host", "alone", "flagged", "shape", "bits"), mismatched=F.col("bits").bitwiseAND(MISMATCHED) != 0, flagged=F.col("flagged"), alone=F.col("alone"))
    decides = (F.col("flagged") * 5 >= F.col("docs") * 4) | ((F.col("alone_hosts") >= least_hosts) & (F.col("alone") * 5 >= F.col("docs")))
    response = said.where(several & (F.col("mismatched") * 5 >= F.col("docs") * 4)).select("shape", F.lit("response").alias("claim"), decides.alias("decides"))

    asked = rows.select(F.explode(F.concat("held", "doubted")).alias("shape")).distinct()
    filled = _repeated(rows.select("host", F.explode("valued").alias("shape")).join(checked_broadcast(asked), "shape", "left_semi"))
    slot = filled.where(several).select("shape", F.lit("slot").alias("claim"), F.lit(True).alias("decides"))
    return body.unionByName(shell).unionByName(response).unionByName(slot)


def _claims() -> Column:
    """What a row shows, as an array of (shape, claim)."""
    claim = lambda shapes, name: F.transform(shapes, lambda x: F.struct(x.alias("shape"), F.lit(name).alias("claim")))
    own = F.when(F.col("shape").isNotNull(), F.array("shape")).otherwise(F.array().cast("array<long>"))
    low = F.transform(F.filter(F.arrays_zip("low", "bits"), lambda x: x["bits"].bitwiseAND(MISMATCHED) != 0), lambda x: x["low"])
    return F.concat(claim(own, "body"), claim(F.when(F.col("shell"), own).otherwise(F.array().cast("array<long>")), "shell"), claim(low, "response"), claim(F.col("doubted"), "slot"))


def _flagged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(uid, id, kinds) of the documents that are residue, with all their evidence."""
    direct = rows.where("size(kinds) > 0").select("uid", "id", F.explode("kinds").alias("kind"), F.lit(True).alias("decides"))
    shown = rows.select("uid", "id", F.inline(F.concat(_claims(), F.transform("held", lambda x: F.struct(x.alias("shape"), F.lit("slot").alias("claim"))))))
    hosts = shown.join(checked_broadcast(found), ["shape", "claim"]).select("uid", "id", F.col("claim").alias("kind"), "decides")
    return direct.unionByName(hosts).groupBy("uid").agg(F.min("id").alias("id"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.bool_or("decides").alias("decides")).where("decides").drop("decides")


def residue(docs: DataFrame, id_col: str, text_col: str, host_col: str, slug_cols: tuple[str, ...] = ()) -> DataFrame:
    """(id, kinds) of the documents that are residue. ``kinds`` holds what the detectors
    found (error, filler, mark, notice, placeholder) and the host evidence (response,
    slot, body, shell)."""
    rows = judged(docs, id_col, text_col, host_col, slug_cols)
    return _flagged(rows, materialize(verdicts(rows))).select("id", "kinds")


def by_evidence(flagged: DataFrame) -> DataFrame:
    """(kind, documents, one_sided): the flagged documents that show each kind of
    evidence, and those of them without host evidence (for kinds of the detectors) or
    without a hit of the detectors (for kinds of host evidence)."""
    host = F.array(*[F.lit(x) for x in ("body", "response", "shell", "slot")])
    both = F.arrays_overlap("kinds", host) & (F.size(F.array_except("kinds", host)) > 0)
    return flagged.select(F.explode("kinds").alias("kind"), both.alias("both")).groupBy("kind").agg(F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("both")).alias("one_sided"))


def without_residue(docs: DataFrame, id_col: str, text_col: str, host_col: str, slug_cols: tuple[str, ...] = (), most: int = 1_000_000) -> DataFrame:
    """(id, text) of the other documents. The one pass that judges the texts writes them
    beside their judgement, and the verdicts, broadcast up to ``most`` shapes, filter
    the written rows where they lie; beyond, the rows' numbers meet them in a join."""
    rows = judged(docs, id_col, text_col, host_col, slug_cols, texts=True)
    decided = materialize(verdicts(rows).where("decides").select(F.xxhash64("shape", "claim").alias("key")).distinct())
    clean = rows.where("size(kinds) = 0").withColumn("keys", F.transform(_claims(), lambda x: F.xxhash64(x["shape"], x["claim"])))
    if rows_up_to(decided, most) > most:
        bad = clean.select("uid", F.explode("keys").alias("key")).join(decided, "key", "left_semi").select("uid").distinct()
        return clean.join(bad, "uid", "left_anti").select("id", "text")
    known = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["key"] for r in decided.toLocalIterator()], np.int64)))

    @F.pandas_udf("boolean")
    def shows(keys: pd.Series) -> pd.Series:
        counts = keys.map(len).to_numpy()
        flat = np.concatenate(keys.to_list()) if counts.sum() else np.zeros(0, np.int64)
        return pd.Series(np.bincount(np.repeat(np.arange(len(counts)), counts)[np.isin(flat, known.value)], minlength=len(counts)) > 0)

    return clean.where(~shows("keys")).select("id", "text")
