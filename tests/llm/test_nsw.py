from __future__ import annotations

import random

from orefold.llm.nsw import SmallWorld, recall, screened


def test_finds_near_sets_and_reports_recall():
    rnd = random.Random(1)
    rows = []
    for _ in range(150):
        t = [f"w{rnd.randrange(400)}" for _ in range(12)]
        rows.append(frozenset(t))
        rows.append(frozenset([*t[1:], "x"]))
    wide = recall(rows, [len(rows)], queries=50)[0]
    assert wide[1] == 1.0 and 0 <= recall(rows, [4], queries=50)[0][1] <= 1


def test_empty_graph_and_empty_sets():
    g = SmallWorld()
    assert g.search(frozenset({"a"})) == []
    g.add(frozenset())
    g.add(frozenset({"a"}))
    assert g.search(frozenset({"a"}))[0] == (1.0, 1)
    assert recall([], [4]) == [(4, 0.0, 0.0)]


def test_screened_rows_follow_the_rule():
    t = frozenset("abcdefgh")
    rows = [(1, "p", "f", t), (2, "p", None, t | {"x"}), (3, "q", "f", t), (4, "p", "f", frozenset({"z"})), (5, "p", None, frozenset()), (6, "p", None, frozenset("z"))]
    assert screened(rows, 8)[0] == [(1, 2), (1, 4)]
