"""Problem 5: rows that fail to parse.

An error-recovering recursive-descent parser of the CSV grammar

    record := field ("," field)*        field := quoted | bare
    quoted := '"' (any but '"' | '""')* '"'        bare := (any but '"' and ",")*

A record that breaks the grammar is reported with the reason and the place of the field
or quote that breaks it. After a broken quote the parser looks for the next record-start
anchor: a line from which on a record with the header's number of fields, a text and a
valid label can be read. From there on it is in step again and returns each record,
valid or with its located reason, until the next broken quote. Each line start is tried
once, and a record read from it ends at the next line with an odd number of quotes, so
the scan is linear.

Results for odd input: a null or blank record fails as ``columns``; so does a record of
an unknown file or of a file with a null header, since no number of fields is right;
a header without a text or label column fails those fields; other columns of the
lines table aren't read, so their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.shared import checked_broadcast

BLANK = " \t\r\n"
#: Spellings of a missing text.
MISSING = frozenset({"", "na", "nan", "null", "none"})


class Broken(Exception):
    """A quoting error: its offset, and that of the field it is in."""

    def __init__(self, at: int, field: int) -> None:
        self.at, self.field = at, field


class Record(NamedTuple):
    """One parsed record: ``reason`` is None if it is valid, else the first that applies,
    found at character ``at``; ``part`` is 0 for the record itself, 1… for recovered ones."""

    part: int
    at: int
    text: str | None
    label: int | None
    reason: str | None


def _quoted(raw: str, at: int, end: int, lines: bool) -> tuple[str, int]:
    start, i = at + 1, at + 1
    while True:
        i = raw.find('"', i, end)
        if i < 0:
            raise Broken(at, at)
        if i + 1 < end and raw[i + 1] == '"':
            i += 2
            continue
        if i + 1 < end and raw[i + 1] != "," and not (lines and (raw[i + 1] == "\n" or raw[i + 1 : i + 3] == "\r\n")):
            raise Broken(i + 1, at)
        return raw[start:i].replace('""', '"'), i + 1


def _bare(raw: str, at: int, end: int) -> tuple[str, int]:
    stop = raw.find(",", at, end)
    stop = end if stop < 0 else stop
    quote = raw.find('"', at, stop)
    if quote >= 0:
        raise Broken(quote, at)
    return raw[at:stop], stop


def _fields(raw: str, at: int, lines: bool) -> tuple[list[str], list[int], int]:
    """The fields of the record that starts at ``at``, their places, and its end: that of
    the text or, with ``lines``, the first line break outside quotes."""
    end, found, places = len(raw), [], []
    stop = end  # of the line, where bare fields end at the latest
    if lines:
        stop = _line_end(raw, at)
    while True:
        places.append(at)
        if at < end and raw[at] == '"':
            value, at = _quoted(raw, at, end, lines)
            if lines and at > stop:
                stop = _line_end(raw, at)
        else:
            value, at = _bare(raw, at, stop - (lines and raw[stop - 1 : stop] == "\r" and stop > at))
        found.append(value)
        if at >= end or raw[at] != ",":
            return found, places, stop
        at += 1  # the comma


def _line_end(raw: str, at: int) -> int:
    stop = raw.find("\n", at)
    return len(raw) if stop < 0 else stop


def fields_of(raw: str) -> list[str]:
    """The fields of a record; raises ``Broken``."""
    return raw.split(",") if '"' not in raw else _fields(raw, 0, False)[0]


class Header:
    """Column places of a file."""

    def __init__(self, line: str | None) -> None:
        names = [x.strip(BLANK) for x in line.split(",")] if line else []
        self.size = len(names)
        self.text = names.index("text") if "text" in names else None
        self.label = names.index("label") if "label" in names else None

    def typed(self, found: list[str], places: list[int], end: int, part: int) -> Record:
        """The record with its values, or the first reason against them and its place:
        that of the first surplus field, of the end where fields are missing, of the field."""
        if len(found) != self.size:
            return Record(part, places[self.size] if len(found) > self.size else end, None, None, "columns")
        text = "" if self.text is None else found[self.text]
        if text.strip(BLANK).lower() in MISSING:
            return Record(part, places[self.text or 0], None, None, "text")
        label = "" if self.label is None else found[self.label].strip(BLANK)
        if label not in ("0", "1"):
            return Record(part, places[self.label or 0], None, None, "label")
        return Record(part, places[0], text, int(label), None)


def records_in(raw: str, header: Header, at: int = 0, in_step: bool = True, part: int = 1) -> Iterator[Record]:
    """The records of a text of several lines, from ``at`` on; unless ``in_step``, ``at``
    is a line start that has to be validated as an anchor first."""
    while at < len(raw):
        try:
            found, places, stop = _fields(raw, at, True)
            row = header.typed(found, places, stop, part)
        except Broken as broken:
            row, stop = Record(part, broken.at, None, None, "quoting"), broken.field
        if in_step or row.reason is None:
            yield row
            part += 1
            in_step = row.reason != "quoting"
        else:
            stop = at  # any line may be the anchor
        at = _line_end(raw, stop) + 1


def parse(raw: str | None, header: Header) -> list[Record]:
    """The record, and what was recovered behind a broken quote."""
    if raw is None or not raw.strip(BLANK):
        return [Record(0, 0, None, None, "columns")]
    try:
        if '"' in raw:
            found, places, _ = _fields(raw, 0, False)
        else:
            found = raw.split(",")
            places = list(accumulate((len(x) + 1 for x in found[:-1]), initial=0))
        return [header.typed(found, places, len(raw), 0)]
    except Broken as broken:
        return [Record(0, broken.at, None, None, "quoting"), *records_in(raw, header, _line_end(raw, broken.field) + 1, in_step=False)]


def _with_headers(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``lines`` with the header of their file. The files table is broadcast if its size
    allows (one row a file), so the lines of a large file stay where they are."""
    heads = checked_broadcast(files.groupBy("file_id").agg(F.min("header").alias("header")))
    return lines.join(heads, "file_id", "left")


def _parsed(rows: DataFrame, keys: dict[str, str], read: Callable[[str | None, Header], Iterable[Record]]) -> DataFrame:
    """The records that ``read`` finds in each row's raw text, behind the row's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Header] = {}
        for b in batches:
            at: list[int] = []
            found: list[Record] = []
            for i, (raw, line) in enumerate(zip(b.column("raw").to_pylist(), b.column("header").to_pylist())):
                if line not in known:
                    known[line] = Header(line)
                before = len(found)
                found += read(raw, known[line])
                at += [i] * (len(found) - before)
            part, place, text, label, reason = zip(*found) if found else ([],) * 5
            values = [pa.array(part, pa.int32()), pa.array(place, pa.int64()), pa.array(text, pa.string()), pa.array(label, pa.int64()), pa.array(reason, pa.string())]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at, pa.int64())) for k in keys], *values], [*keys, "part", "at", "text", "label", "reason"])

    schema = ", ".join(f"{k} {t}" for k, t in keys.items())
    return rows.select(*keys, "raw", "header").mapInArrow(run, f"{schema}, part int, at long, text string, label long, reason string")


def parse_records(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(line_id, part, at, text, label, reason) of every record and recovered record."""
    rows = _with_headers(lines.select(F.col("line_id").cast("long").alias("line_id"), "file_id", "raw"), files)
    return _parsed(rows, {"line_id": "long"}, parse)


def parse_blocks(lines: DataFrame, files: DataFrame, size: int = 64) -> DataFrame:
    """(file_id, block, part, at, text, label, reason): the records found in a file's text
    where it wasn't split into records: the lines of each block of ``size`` line numbers
    are put together and read in one scan that resumes after each broken quote.

    Line numbers are unique in a file, so a block has at most ``size`` lines, however
    large the file; null lines are empty."""
    numbered = lines.where("line_id is not null and file_id is not null").select(F.col("file_id").cast("long").alias("file_id"), F.floor(F.col("line_id") / size).cast("long").alias("block"), "line_id", F.coalesce("raw", F.lit("")).alias("raw"))
    ordered = F.array_sort(F.collect_list(F.struct("line_id", "raw")))
    blocks = numbered.groupBy("file_id", "block").agg(F.array_join(F.transform(ordered, lambda x: x["raw"]), "\n").alias("raw"))
    return _parsed(_with_headers(blocks, files), {"file_id": "long", "block": "long"}, records_in)


def valid_rows(parsed: DataFrame, recovered: bool = False) -> DataFrame:
    """(line_id, text, label) of the valid rows, with ``recovered`` also those behind anchors."""
    rows = parsed.where("reason is null")
    return (rows if recovered else rows.where("part = 0")).select("line_id", "text", "label")


def failures(parsed: DataFrame) -> DataFrame:
    """(line_id, reason, at) of the records that fail."""
    return parsed.where("part = 0 and reason is not null").select("line_id", "reason", "at")
