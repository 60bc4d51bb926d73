import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.operators.records import Broken, Header, failures, fields_of, parse, parse_blocks, parse_records, records_in, valid_rows

H = Header("text,label")


@pytest.mark.parametrize(
    "raw, reason",
    [
        (None, "columns"), ("", "columns"), (" \t\r\n", "columns"), ('"abc,0', "quoting"), ('"abc"x,0', "quoting"), ('ab"c,0', "quoting"), (' "abc",0', "quoting"), ('"abc" ,0', "quoting"),
        ("abc", "columns"), ("a,b,0", "columns"), (",0", "text"), ("  ,0", "text"), ("NaN,0", "text"), ("NULL,0", "text"), ('"none",1', "text"), ("a,2", "label"), ("a,", "label"), ("a,0.0", "label"), ("a,０", "label"),
        ("a,0", None), ("a, 1 ", None), ('"a,b",1', None), ('"say ""x""",0', None), ('"two\nlines",0', None), ("back\\slash,0", None), ('"a",\t1', None), ('"",0', "text"), ("x" * 100_000 + ",1", None),
    ],
)
def test_reasons(raw, reason):
    assert parse(raw, H)[0].reason == reason


def test_first_reason_wins():
    assert parse('a"b,c,d', H)[0].reason == "quoting"
    assert parse("NaN,x,1", H)[0].reason == "columns"
    assert parse("NaN,x", H)[0].reason == "text"


def test_place_of_the_error():
    assert parse('ok,"open', H)[0].at == 3
    assert parse('"a"b,0', H)[0].at == 3


def test_recovery_behind_a_broken_quote():
    found = parse('"open,0\nnext,1\n"quoted, too",0', H)
    assert [(r.part, r.text, r.label, r.reason) for r in found] == [(0, None, None, "quoting"), (1, "next", 1, None), (2, "quoted, too", 0, None)]
    assert parse('"open,0\nno anchor', H)[1:] == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab ,"\n\\', max_size=8), min_size=1, max_size=4))
def test_well_formed_records_parse_like_the_csv_module(values):
    out = io.StringIO()
    csv.writer(out, lineterminator="", quoting=csv.QUOTE_ALL).writerow(values)
    assert fields_of(out.getvalue()) == values


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a,"', max_size=12))
def test_grammar_against_its_regular_expression(raw):
    import re

    ok = re.fullmatch(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', raw) is not None
    try:
        fields_of(raw)
        assert ok
    except Broken:
        assert not ok


def test_tables(spark, rows):
    lines = spark.createDataFrame([(1, 1, "a,0", "x"), (2, 2, "1,b", "x"), (3, 9, "a,0", "x"), (4, None, None, None), (5, 1, '"c', "x"), (6, 3, "a,0", None)], "line_id long, file_id long, raw string, header string")
    files = spark.createDataFrame([(1, "text,label"), (2, " label , text "), (3, None)], "file_id long, header string")
    found = parse_records(lines, files)
    assert rows(valid_rows(found)) == [(1, "a", 0), (2, "b", 1)]
    assert rows(failures(found).select("line_id", "reason")) == [(3, "columns"), (4, "columns"), (5, "quoting"), (6, "columns")]
    assert parse_records(lines.limit(0), files).count() == 0
    assert failures(parse_records(lines, files.limit(0))).count() == 6


def found(raw, header):
    return [(r.part, r.at, r.text, r.label, r.reason) for r in parse(raw, Header(header))]


def test_recovery_returns_each_record_and_located_errors():
    lines = ['1,"broken,0', "2,good,1", "3,good,0", "4,good,7", "5,good,1"]
    assert found("\n".join(lines), "id,text,label") == [(0, 2, None, None, "quoting"), (1, 12, "good", 1, None), (2, 21, "good", 0, None), (3, 37, None, None, "label"), (4, 39, "good", 1, None)]
    lines = ['a"b,0', "no anchor", "x,7", "y,1", '"z,0', "NaN,1", "w,0", "v,0,0", "u", '"two\nlines, one ""record""",1\r', "", "t,1\r", ""]
    got = found("\n".join(lines), "text,label")
    assert [r[2:] for r in got] == [(None, None, "quoting"), ("y", 1, None), (None, None, "quoting"), ("w", 0, None), (None, None, "columns"), (None, None, "columns"), ('two\nlines, one "record"', 1, None), (None, None, "columns"), ("t", 1, None)]
    text = "\n".join(lines)
    assert [text[r[1] :][:4] for r in got] == ['"b,0', "y,1\n", "two\n", "w,0\n", "0\nu\n", '\n"tw', '"two', "\nt,1", "t,1\r"]


@pytest.mark.parametrize("raw, at", [("a,b,0", 4), ("a", 1), ('"x, y",NaN', 7), ("ab,7", 3), (" null ,0", 0), ('"a,b"', 5)])
def test_places_of_fields_that_fail(raw, at):
    r = parse(raw, H)[0]
    assert r.reason and r.at == at


@pytest.mark.parametrize("line", ["bad label,7", 'open "quote,0', '"odd,1', '"a""', 'x,"y', ',"', '"""', '","', '""', 'a,",",",', '"a\n"'])
def test_recovery_is_linear(line):
    import time

    start = time.process_time()
    got = parse('"broken,0\n' + "\n".join([line] * 10_000) + "\nlast,1", H)
    assert time.process_time() - start < 1
    assert got[-1].text == "last" or line.count('"') % 2 or "\n" in line


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet='ab,"\n', min_size=1, max_size=6).filter(lambda x: x.strip(" \n")), st.sampled_from("01")), max_size=6))
def test_whole_texts_come_back(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL).writerows(rows)
    assert [(r.text, str(r.label)) for r in records_in(out.getvalue(), H)] == rows


def test_blocks(spark, rows):
    data = [(0, 1, "a,0"), (1, 1, '"b,1'), (2, 1, "c,1"), (3, 1, "d,7"), (4, 1, None), (5, 2, "1,e"), (6, 2, '1,"e"x'), (7, 2, "0,f"), (64, 1, "g,1"), (65, 9, "g,1"), (None, 1, "h,1"), (66, None, "h,1")]
    lines = spark.createDataFrame(data, "line_id long, file_id long, raw string")
    files = spark.createDataFrame([(1, "text,label"), (2, "label,text")], "file_id long, header string")
    got = rows(parse_blocks(lines, files))
    assert got == sorted(
        [(1, 0, 1, 0, "a", 0, None), (1, 0, 2, 4, None, None, "quoting"), (1, 0, 3, 9, "c", 1, None), (1, 0, 4, 15, None, None, "label"), (1, 1, 1, 0, "g", 1, None)]
        + [(2, 0, 1, 0, "e", 1, None), (2, 0, 2, 9, None, None, "quoting"), (2, 0, 3, 11, "f", 0, None), (9, 1, 1, 0, None, None, "columns")],
        key=lambda r: tuple((x is None, str(x)) for x in r),
    )
    assert parse_blocks(lines.limit(0), files).count() == 0
