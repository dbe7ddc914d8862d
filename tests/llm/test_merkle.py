from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orefold.llm import merkle


def root(text):
    return merkle.fingerprint(text)[0]


BASE = '{"formula": "Na5Fe9AlO", "charge": -2, "elements": {"Na": 5, "Fe": 9}, "list": [1, "a b"], "v": 1.5, "n": null, "t": true}'


@pytest.mark.parametrize(
    "other",
    [
        '{"t":true,"n":null,"v":1.50,"list":[1,"A-B"],"elements":{"Fe":9.0,"Na":5},"charge":-2e0,"formula":"na5 FE9.alO"}',
        json.dumps(json.loads(BASE), indent=4),
        BASE.replace("formula", "For mu_la").replace("Na5Fe9AlO", "[N|a5 Fe9 Al'O]"),
    ],
)
def test_dress_does_not_count(other):
    assert root(other) == root(BASE)


@pytest.mark.parametrize(
    "other",
    [BASE.replace("-2", "2"), BASE.replace("1.5", "15"), BASE.replace('[1, "a b"]', '["a b", 1]'), BASE.replace("null", "0"), BASE.replace("true", '"true"'), BASE.replace('"Na": 5', '"Na": "5"'), BASE.replace("Na5", "Na5.1"), BASE[:-1] + ', "x": 1}'],
)
def test_content_counts(other):
    assert root(other) != root(BASE)


def test_a_point_between_digits_stays():
    assert merkle.normal("Sr1.1.6Nb.") == "sr1.1.6nb" and merkle.normal("1.6") != merkle.normal("16") and merkle.normal(".5 a.b 3.") == "5ab3"
    assert merkle.normal("é-É_ß") == "ééss" and merkle.normal("x​y") == "xy"


def test_no_digest_for_nothing():
    assert merkle.fingerprint(None) == (None, None) and merkle.fingerprint("  ") == (None, None)
    assert root("not json") == root("NOT-JSON!") and root("[]") != root("{}") and root('{"a":1,"A":1}') != root('{"a":1}')


def test_constants_outside_json_are_leaves_of_their_own(spark):
    forms = [merkle.fingerprint(t) for t in ('{"v": NaN}', '{"v": Infinity}', '{"v": -Infinity}', '{"v": "NaN"}', '{"v": null}', '{"v": 0}', "NaN")]
    assert len({r for r, _ in forms}) == len({f for _, f in forms}) == 7
    data = [(1, '{"v": NaN, "w": [Infinity]}'), (2, '{"W":[ Infinity],"V":NaN}'), (3, '{"v": NaN, "w": [-Infinity]}')]
    df = spark.createDataFrame(data, "id bigint, t string")
    assert [tuple(r) for r in merkle.copies(df, "id", "t").collect()] == [(1, 2)]
    assert sorted(map(tuple, merkle.distinct_records(df, "id", "t").collect())) == [(1, 2), (3, 1)]


JSON = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text("abC 1.-_é", max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "c", "d"]), c, max_size=3), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(JSON, st.randoms())
def test_shuffled_objects_share_a_root(value, rnd):
    def shuffled(v):
        if isinstance(v, dict):
            items = [*v.items()]
            rnd.shuffle(items)
            return {k.upper() if rnd.random() < 0.5 else k: shuffled(x) for k, x in items}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    assert merkle.fingerprint(json.dumps(value))[1] == merkle.fingerprint(json.dumps(shuffled(value), indent=1))[1]


def test_copies(spark):
    rnd = random.Random(3)
    data, want = [], []
    for g in range(40):
        n = 900 if g == 0 else rnd.choice([1, 1, 2, 5])
        ids = rnd.sample(range(g * 10_000, g * 10_000 + 9999), n)
        for i in ids:
            doc = {"f": f"X{g}", "v": g / 4}
            data.append((i, json.dumps(doc) if rnd.random() < 0.5 else json.dumps(dict(reversed(doc.items()))).replace("X", "x ")))
        want += [(min(ids), i) for i in ids if i != min(ids)]
    data += [(-1, None), (-2, None), (-3, "")]
    df = spark.createDataFrame(data, "id bigint, t string").selectExpr("*", "t AS form", "id AS n", "id AS keep_id").repartition(5)
    assert sorted(map(tuple, merkle.copies(df, "id", "t").collect())) == sorted(want)
    assert {r.keep_id: r.copies for r in merkle.distinct_records(df, "id", "t").where("copies = 900").collect()} == {min(i for i, _ in data[:900]): 900}
    assert merkle.copies(df.limit(0), "id", "t").count() == 0


def test_forms_that_share_a_digest_are_told_apart(spark, tmp_path):
    rows = [(1, b"r", "x"), (2, b"r", "y"), (3, b"r", "x"), (4, b"r", "y"), (5, b"r", "z"), (6, b"q", "x"), (7, b"q", "x")]
    found = merkle.confirmed(spark.createDataFrame(rows, "id bigint, root binary, form string"), "id", str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 3), (2, 4), (6, 7)]


def test_repeated_rows_and_long_texts(spark):
    long = json.dumps({"a": "x y" * 200_000})
    df = spark.createDataFrame([(1, long), (1, long), (2, long.replace("x y", "X-Y"))], "id bigint, t string")
    assert [tuple(r) for r in merkle.copies(df, "id", "t").collect()] == [(1, 2)]
