from __future__ import annotations

import json

from orefold.operators import drift

SCHEMA = "producer string, file_seq int, payload string, row_no bigint"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def runs(spark, files):
    data, n = [], 0
    for producer, seq, docs in files:
        for d in docs:
            data.append((producer, seq, d if d is None or isinstance(d, str) else json.dumps(d), n))
            n += 1
    return spark.createDataFrame(data, SCHEMA)


def brute(files):
    """Literal reading of the definition."""
    seen, order = {}, {}
    for producer, seq, docs in files:
        order.setdefault(producer, set()).add(seq)
        held = seen.setdefault((producer, seq), {})
        for d in docs:
            for path, kind, content in drift.leaves_of(d if d is None or isinstance(d, str) else json.dumps(d)):
                held.setdefault(path, set()).add((kind, content))
    out = []
    for producer, seqs in order.items():
        seqs = sorted(seqs)
        for a, b in zip(seqs, seqs[1:]):
            old, new = seen[producer, a], seen[producer, b]
            gone, come = set(old) - set(new), set(new) - set(old)
            pairs = [(g, c) for g in gone for c in come if old[g] & new[c]]
            out += [(producer, b, "renamed", g, c) for g, c in pairs]
            out += [(producer, b, "removed", g, "") for g in gone - {g for g, _ in pairs}]
            out += [(producer, b, "added", "", c) for c in come - {c for _, c in pairs}]
            out += [(producer, b, "retyped", p, p) for p in set(old) & set(new) if {k for k, _ in old[p]} != {k for k, _ in new[p]}]
    return sorted(out)


FILES = [
    ("a", 1, [{"v": "1.0", "n": {"x": 1, "y": True}}, {"v": "1.1", "n": {"x": 2}}]),
    ("a", 2, [{"version": "1.1", "n": {"x": "2", "y": None}}, None, "{broken"]),
    ("a", 5, [{"version": [1, 1], "n": {"x": "2"}, "deep": {"er": {"z": 0.50}}}]),
    ("a", 6, [{"version": [1, 1], "half": 0.5, "n": {"x": "2"}}]),
    ("b", 3, [{"v": "1.0"}]),
    ("b", 3, [{"v": "1.0"}]),
    ("c", 1, [{"v": 1}]),
    ("c", 2, ["[]", None]),
    ("c", 4, [{"v": 1.0}]),
]


def test_changes_match_the_definition(spark):
    got = rows(drift.changes(runs(spark, FILES)))
    assert got == brute(FILES)
    assert ("a", 6, "renamed", "deep.er.z", "half") in got  # 0.50 and 0.5 are one number
    assert ("a", 2, "retyped", "n.x", "n.x") in got and ("a", 2, "removed", "n.y", "") in got
    assert not [g for g in got if g[0] == "b"]  # one file, nothing to compare with


def test_a_value_shared_by_several_paths_gives_every_pair(spark):
    files = [("a", 1, [{"p": "x"}]), ("a", 2, [{"q": "x", "r": "x"}])]
    assert rows(drift.changes(runs(spark, files))) == [("a", 2, "renamed", "p", "q"), ("a", 2, "renamed", "p", "r")]


def test_empty_null_and_clashing_columns(spark):
    empty = runs(spark, [])
    assert rows(drift.changes(empty)) == []
    odd = spark.createDataFrame([(None, 1, "{}", 1), ("a", None, "{}", 2), ("a", 1, None, 3)], SCHEMA).selectExpr("*", "payload AS path", "1 AS before", "2 AS kind")
    assert rows(drift.changes(odd)) == []


def test_unify_casts_by_alias(spark):
    df = runs(spark, [("a", 1, [{"tax_version": "1.2", "counts": {"admitted": "7"}, "mean_reward": "0.5"}, {"meta": {"taxonomy_version": [1, 2]}, "mean_reward": "none"}, None])])
    got = [(r.taxonomy_version, r.n_admitted, r.mean_reward) for r in drift.unify(df, "row_no", "payload").orderBy("row_no").collect()]
    assert got[0] == ("1.2", 7, 0.5) and got[1][1:] == (None, None) and got[2] == (None, None, None)
    assert got[1][0] is not None


def test_unify_keeps_every_leaf(spark):
    """Paths outside the alias table, unknown spellings, losers of a column and values that do not cast stay."""
    docs = [
        {"run_id": "r", "exit_code": 0, "timing": {"wall_seconds": 1.50}, "is_replay": False, "scoring_law": "new@1", "n": None},
        {"mean_reward": "none", "counts": {"admitted": 7.5}, "taxonomyVersion": "1.2", "meta": {"taxonomy_version": "1.3"}},
        {"a.b": 1, "a": {"b": "1"}},
        "{broken",
        None,
    ]
    got = drift.unify(runs(spark, [("a", 1, docs)]), "row_no", "payload").orderBy("row_no").collect()
    others = [[tuple(x) for x in r.others] for r in got]
    assert others[0] == [("exit_code", "number", "0"), ("is_replay", "boolean", "false"), ("scoring_law", "string", "new@1"), ("timing.wall_seconds", "number", "1.5")]
    assert others[1] == [("counts.admitted", "number", "7.5"), ("mean_reward", "string", "none"), ("taxonomyVersion", "string", "1.2")]
    assert got[0].run_id == "r" and (got[1].taxonomy_version, got[1].mean_reward, got[1].n_admitted) == ("1.3", None, None)
    assert others[2] == [("a.b", "number", "1"), ("a.b", "string", "1")] and others[3:] == [[], []]


def test_renames_tell_what_an_unknown_spelling_stands_for(spark):
    files = [
        ("a", 1, [{"reward_fn_id": "x@1", "mean_reward": 0.5}]), ("a", 2, [{"law": "x@1", "grade": 0.5}]), ("a", 4, [{"code": "x@1"}, {"code": "y@2"}]),
        ("b", 1, [{"law": "z@3"}]),
        ("c", 1, [{"status": "same", "run_id": "same"}]), ("c", 2, [{"odd": "same"}]),
    ]
    df = runs(spark, files)
    got = drift.unify(df, "row_no", "payload").orderBy("row_no").collect()
    assert [r.reward_fn_id for r in got] == ["x@1", "x@1", "x@1", "y@2", None, None, None]
    assert [tuple(x) for x in got[1].others] == [("grade", "number", "0.5")]  # equal numbers may be chance
    assert [tuple(x) for x in got[4].others] == [("law", "string", "z@3")] and [tuple(x) for x in got[6].others] == [("odd", "string", "same")]
    named = {(r.producer, r.path): r.column for r in drift.cast_table(df).collect()}
    assert named["a", "law"] == named["a", "code"] == "reward_fn_id" and named["b", "law"] == "law" and named["c", "odd"] == "odd"


def test_unify_keeps_rows_without_file_and_clashing_names(spark):
    df = spark.createDataFrame([(None, 1, '{"run_id": "r", "path": "p"}', 1), ("a", None, '{"row": 1}', 2), ("a", 1, None, 3)], SCHEMA).selectExpr("*", "'x' AS path", "'y' AS column", "9 AS row", "0 AS n")
    got = drift.unify(df, "row_no", "payload").orderBy("row_no").collect()
    assert [(r.row_no, r.run_id, [tuple(x) for x in r.others]) for r in got] == [(1, "r", [("path", "string", "p")]), (2, None, [("row", "number", "1")]), (3, None, [])]
    assert drift.unify(df.limit(0), "row_no", "payload").count() == 0


def test_arrays_have_one_canonical_string(spark):
    docs = ['{"tax_version": [1, 2.0, "2", null, true, {"b": [], "a": "\\""}]}', '{"tax_version": [1.0,2,"2",null,true,{"a":"\\u0022","b":[ ]}], "x": [[10]]}']
    got = drift.unify(runs(spark, [("a", 1, docs)]), "row_no", "payload").orderBy("row_no").collect()
    assert {r.taxonomy_version for r in got} == {'[1,2,"2",null,true,{"a":"\\"","b":[]}]'}
    assert [tuple(x) for x in got[1].others] == [("x", "array", "[[10]]")]


def test_lifespans_are_islands(spark):
    df = runs(spark, FILES)
    spans = drift.lifespans(drift.catalogue(df, "producer", "file_seq", "payload"), drift.files_of(df, "producer", "file_seq"))
    got = {(r.first_seq, r.last_seq) for r in spans.where("producer = 'c' AND path = 'v'").collect()}
    assert got == {(1, 1), (4, 4)}
    assert {r.cast_to for r in drift.casts(spans).where("path = 'version'").collect()} == {"string", "array"}
