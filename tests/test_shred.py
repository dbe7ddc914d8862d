from __future__ import annotations

import json

from orefold.operators import shred


def site(e, f):
    return {"element": e, "frac_coords": f, "occupancy": 1}


P1 = {"proposal_id": "a", "composition": {"formula": "NaCl"}, "structure": {"sites": [site("Na", [0, 0.5, 0.25]), None, site("Cl", "0.1, 0.2 0.3"), {"occupancy": 1}]}, "claimed_properties": [{"name": "x", "value": 1}, None, {"basis": "b", "claims": [{"name": "y", "value": 2}, {"name": "z", "value": 3}]}]}
P2 = {"proposal_id": "b", "structure": {"blocks": [{"name": "core", "sites": [site("Li", {"x": 0.1, "y": "0.2", "z": 0.3})]}, {"name": "shell", "sites": []}, {"sites": [site("O", ["0.5", "0.5", "0.5"])]}]}, "claimed_properties": {"gap": {"value": 1, "unit": "eV"}, "dens": {"value": 2}}}
P3 = {"proposal_id": "c", "structure": json.dumps({"cell": {"basis": {"sites": {"s1": site("K", None), "s0": site("F", [1, 2])}}}}), "claimed_properties": {"name": "v", "value": 1, "unit": "V"}}
P4 = {"proposal_id": "d", "structure": {"sites": site("Mg", [0.99996, -0.00004, 0])}, "claimed_properties": None}
WANT = [
    (0, "claim", 0, "x", -1, -1, -1), (0, "claim", 1, "y", -1, -1, -1), (0, "claim", 2, "z", -1, -1, -1),
    (0, "site", 0, "Na", 0, 5000, 2500), (0, "site", 1, "Cl", 1000, 2000, 3000), (0, "site", 2, "", -1, -1, -1),
    (1, "claim", 0, "gap", -1, -1, -1), (1, "claim", 1, "dens", -1, -1, -1), (1, "site", 0, "Li", 1000, 2000, 3000), (1, "site", 1, "O", 5000, 5000, 5000),
    (2, "claim", 0, "v", -1, -1, -1), (2, "site", 0, "K", -1, -1, -1), (2, "site", 1, "F", -1, -1, -1),
    (3, "site", 0, "Mg", 10000, 0, 0),
]


def children(spark, payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "batch_no bigint, payload string").selectExpr("*", "batch_no AS k", "'x' AS child")
    return sorted(tuple(r) for r in shred.children(df, "batch_no", "payload").collect())


def test_every_shape(spark):
    listed = {"proposals": [None, P1, P2, None, P3, P4]}
    keyed = {"proposals": {"a": P1, "b": P2, "n": None, "c": P3, "d": P4}}
    paged = {"proposals": {"page": 1, "list": [P1, P2, P3, P4]}}
    got = children(spark, [json.dumps(listed), json.dumps(keyed, indent=1), json.dumps(paged)])
    for b in range(3):
        assert [g[1:] for g in got if g[0] == b] == WANT


def test_bad_payloads_have_no_rows(spark):
    assert children(spark, [None, "", "{", "[]", "{}", '{"proposals": null}', '{"proposals": []}', '{"proposals": [{}]}', '"text"', "5"]) == []
    assert shred.children(spark.createDataFrame([], "k bigint, p string"), "k", "p").count() == 0


def test_nodes_rebuild_the_document(spark):
    doc = {"a": [1, {"b": None, "c": [True, "x"]}], "d": {"e": 1.5}}
    nodes = {r.node: r for r in shred.shred(spark.createDataFrame([(1, json.dumps(doc))], "k bigint, p string"), "k", "p").collect()}

    def build(n):
        kids = sorted((c for c in nodes.values() if c.parent == n), key=lambda c: c.ordinal)
        r = nodes[n]
        if r.kind == "object":
            return {c.label: build(c.node) for c in kids}
        if r.kind == "array":
            return [build(c.node) for c in kids]
        return None if r.kind == "null" else r.scalar if r.kind == "string" else json.loads(r.scalar)

    assert build(0) == doc


def test_links_to_parents(spark):
    df = spark.createDataFrame([(7, json.dumps({"proposals": [None, P1, P2]}))], "batch_no bigint, payload string")
    parents = shred.proposals(df, "batch_no", "payload")
    assert sorted((r.proposal_pos, r.proposal_id, r.formula) for r in parents.collect()) == [(0, "a", "NaCl"), (1, "b", None)]
    assert shred.orphaned(shred.children(df, "batch_no", "payload"), parents, "batch_no").count() == 0


def test_large_payload(spark):
    big = {"proposals": [{"proposal_id": str(i), "structure": {"sites": [site("Na", [0, 0, 0])] * 100}} for i in range(300)]}
    assert len(children(spark, [json.dumps(big)] * 3)) == 90_000
