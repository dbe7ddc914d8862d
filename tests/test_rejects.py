from __future__ import annotations

import csv
import io

import pytest

from orefold.operators import rejects

OK = 'a,b,1.5,eV,,,300,K,"x ""y"", z"'


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        (OK, None),
        ('"a","b","1.5",eV,,,,,', None),
        ('a,b," .5 ",eV,,,   ,K,"two\nlines"', None),
        ("a,b,5.,eV,,,5e2,K,", None),
        ("a,b,+1E-3,eV,,,-.5e+2,K,", None),
        ('a,b,1,eV,,,1,K,"open', "quoting"),
        ('a,b,1,eV,,,1,K,"x" y', "quoting"),
        ('a,b,1,e"V,,,1,K,', "quoting"),
        ('a,b,1,eV,,,1,K, "x"', "quoting"),
        ("a,b,1", "column_count"),
        ("", "column_count"),
        ("a,b,1,eV,,,1,K,x,y", "column_count"),
        ("a,b,,eV,,,1,K,", "value"),
        ("a,b, ,eV,,,bad,K,", "value"),
        ("a,b,1e999,eV,,,1,K,", "value"),
        ("a,b,nan,eV,,,1,K,", "value"),
        ("a,b,−1,eV,,,1,K,", "value"),
        ("a,b,٣,eV,,,1,K,", "value"),
        ('a,b,"1,5",eV,,,1,K,', "value"),
        ("a,b,1\n,eV,,,1,K,", "value"),
        ("a,b,1,eV,,,0x1F,K,", "temperature"),
        ("a,b,1,eV,,,-inf,K,", "temperature"),
        (None, "quoting"),
    ],
)
def test_reason(spark, line, reason):
    got = rejects.reject_lines(spark.createDataFrame([(1, line)], "id bigint, line string"), "id", "line").collect()
    assert [r.reason for r in got] == [reason]


def test_loaded_lines_agree_with_a_csv_reader(spark):
    lines = [OK, OK, 'p,q,"2",V,0.1,literature,,,"a,b\n""c"""', "x,y,z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id bigint, line string").selectExpr("*", "line AS fields", "id AS reason", "1 AS n")
    r = rejects.reject_lines(df, "id", "line")
    got = {x.id: x for x in rejects.load_lines(r, "id").collect()}
    assert sorted(got) == [0, 1, 2]
    for i in got:
        want = next(csv.reader(io.StringIO(lines[i], newline="")))
        assert got[i].note == want[8] and got[i].value == float(want[2]) and got[i].unit == want[3]
    assert got[2].temperature is None


def test_long_and_many(spark):
    wide = "a," * 200_000
    long = '"' + 'x""' * 300_000 + '"'
    df = spark.createDataFrame([(1, wide), (2, f"a,b,1,eV,,,1,K,{long}"), (3, f"a,b,1,eV,,,1,K,{long}z")] + [(10 + i, "a,b,oops,eV,,,1,K,") for i in range(500)], "id bigint, line string")
    got = {r.id: r.reason for r in rejects.reject_lines(df, "id", "line").collect()}
    assert got[1] == "column_count" and got[2] is None and got[3] == "quoting"
    assert {got[10 + i] for i in range(500)} == {"value"}


def test_empty(spark):
    assert rejects.reject_lines(spark.createDataFrame([], "id bigint, line string"), "id", "line").count() == 0
