"""Rejected and loaded CSV records."""

import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.operators import rejects

SCHEMA = "line_id bigint, file_name string, line_no int, raw_line string, reason string"
GOOD = ["2020-01-02", "NCT01234567", "A title", "", "Some text", "2021-03-04", "Phase 1"]


def line(*fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(fields)
    return out.getvalue()


def reasons(spark, lines):
    rows = [(i, "f", 2, t, "clash") for i, t in enumerate(lines)]
    found = {r["line_id"]: r["reason"] for r in rejects.rejected(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [found.get(i) for i in range(len(lines))]


def test_reasons(spark):
    with_ = lambda i, v: line(*GOOD[:i], v, *GOOD[i + 1 :])
    cases = {
        line(*GOOD): None,
        with_(2, 'a "quoted", title\nof two lines'): None,
        with_(4, "tab\tand\nline end"): None,
        '2020-01-02,NCT01234567,"open,,text,2021-03-04,': "quoting",
        '2020-01-02,NCT01234567,"shut"x,,text,2021-03-04,': "quoting",
        '2020-01-02,NCT01234567,in"side,,text,2021-03-04,': "quoting",
        '2020-01-02,NCT01234567,"""doubled""",,text,2021-03-04,': None,
        '"","NCT01234567","","","text","2021-03-04",""': None,
        line(*GOOD[:6]): "column_count",
        line(*GOOD, "more"): "column_count",
        "": "column_count",
        None: "column_count",
        with_(1, "NCT0123456"): "invalid_value",
        with_(1, " NCT01234567"): "invalid_value",
        with_(1, "NCT01234567\n"): "invalid_value",
        with_(1, "ChiCTR2000012345"): None,
        with_(1, "CTRI/2021/05/0338834"): None,
        with_(1, "2020-123456-12"): None,
        with_(1, "DRKS00012345"): None,
        with_(1, "jRCT2031200123"): None,
        with_(4, ""): "invalid_value",
        with_(4, "  \t"): "invalid_value",
        with_(4, "bad � sign"): "invalid_value",
        with_(4, "bell\x07"): "invalid_value",
        with_(4, "next\x85line"): "invalid_value",
        with_(5, "2021-02-29"): "invalid_value",
        with_(5, "2020-02-29"): None,
        with_(5, "2021-2-09"): "invalid_value",
        with_(5, "0000-01-01"): "invalid_value",
        with_(4, "long " * 50_000): None,
        with_(4, '"' * 20_000): None,
    }
    got = reasons(spark, list(cases))
    assert [(k and k[:60], w, g) for (k, w), g in zip(cases.items(), got, strict=True) if w != g] == []


def test_headers_and_empty_table(spark):
    df = spark.createDataFrame([(1, "f", 1, "anything", None), (2, "f", None, "x", None)], SCHEMA)
    assert [tuple(r) for r in rejects.rejected(df).collect()] == [(2, "column_count")]
    assert rejects.loaded(df).count() == 0
    assert rejects.rejected(df.limit(0)).count() == 0


def test_loaded_row(spark):
    df = spark.createDataFrame([(7, "f", 2, line(*GOOD[:2], 'x, "y"', *GOOD[3:]), None)], SCHEMA)
    row = rejects.loaded(df).collect()[0].asDict()
    assert row == {"row_id": 7, "trial_id": "NCT01234567", "title": 'x, "y"', "brief_title": None, "abstract": "Some text", "publication_date": "2021-03-04", "date_added": "2020-01-02", "phase": "Phase 1", "registry": "NCT", "received_at": None}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab", \n;', max_size=8), min_size=7, max_size=7), min_size=30, max_size=30))
def test_written_records_are_never_broken(spark, records):
    lines = [line(*r) for r in records]
    assert not {"quoting", "column_count"} & set(reasons(spark, lines))


@pytest.mark.parametrize("cut", [0, 1])
def test_repeated_lines_come_out_each(spark, cut):
    df = spark.createDataFrame([(5, "f", 2, "x", None)] * 3, SCHEMA)
    assert rejects.rejected(df).count() == 3
