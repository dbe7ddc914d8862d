"""Deeply nested records into flat tables: an adjacency table of nodes, then entities pivoted from it.

A payload becomes nodes (node, parent, label, ordinal, kind, scalar) in the order of writing. A table of shapes
says which nodes are proposals, sites and claims; object nodes are joined with their scalar children over the
parent column and pivoted into entities. Links never leave the payload they come from, so the joins are made on
whole columns inside one Arrow batch and nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "node int, parent int, label string, ordinal int, kind string, scalar string"
#: Payloads are shredded in groups of about this many characters, so that a batch of large ones stays small.
CHUNK_CHARS = 1 << 21
#: Keys that make an object a proposal, a site or a claim.
PROPOSAL_KEYS = ("proposal_id", "composition", "structure", "claimed_properties", "synthesis_hint", "generator_confidence", "rationale")
SITE_KEYS = ("element", "frac_coords", "occupancy", "oxidation_state", "label")
CLAIM_KEYS = ("name", "value", "unit", "uncertainty", "basis", "confidence")
NAMING_KEYS = ("name", "value", "unit")
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")

KINDS = ("object", "array", "null", "boolean", "string", "number")
OBJECT, ARRAY, NULL, BOOLEAN, STRING, NUMERIC = range(6)
_KIND = {dict: OBJECT, list: ARRAY, type(None): NULL, bool: BOOLEAN, str: STRING, int: NUMERIC, float: NUMERIC}
_FAMILIES = {"proposal": PROPOSAL_KEYS, "site": SITE_KEYS, "claim": CLAIM_KEYS, "naming": NAMING_KEYS, "group": ("claims",)}
_BIT = {name: 1 << i for i, name in enumerate(_FAMILIES)}
#: Labels the shapes know, by number; 0 is any other.
_LABEL = {name: i for i, name in enumerate(dict.fromkeys(["", *PROPOSAL_KEYS, *SITE_KEYS, *CLAIM_KEYS, "proposals", "sites", "claims", "formula"]))}
_BITS = np.array([sum(_BIT[f] for f, keys in _FAMILIES.items() if name in keys) for name in _LABEL], np.int64)


@dataclass(frozen=True)
class Shape:
    """A node below one of `under`, with the label (any if empty), kinds and children asked for, becomes `part`.

    has: it has a key of this family; lacks: it has none; children: 'objects' for only objects (and nulls),
    'other' for at least one that is none, or no child at all; 'none' for no child."""

    under: str
    part: str
    label: str = ""
    kinds: tuple[int, ...] = tuple(range(6))
    has: str = ""
    lacks: str = ""
    children: str = ""


_OBJ, _BOTH = (OBJECT,), (OBJECT, ARRAY)
#: The shapes of a batch; of several that fit a node the first counts. proposal, site and claim are entities.
SHAPES = (
    Shape("root", "proposal", "proposals", _OBJ, has="proposal"),
    Shape("root", "proposals", "proposals", _BOTH),
    Shape("proposals", "proposal", "", _OBJ, has="proposal"),
    Shape("proposals", "proposal", "", _OBJ, children="none"),
    Shape("proposals", "proposals", "", _BOTH),
    Shape("proposal", "structure", "structure"),
    Shape("proposal", "claim", "claimed_properties", _OBJ, has="naming", children="other"),
    Shape("proposal", "claims", "claimed_properties"),
    Shape("structure", "site", "sites", _OBJ, has="site"),
    Shape("structure", "sites", "sites"),
    Shape("structure", "structure", "", _BOTH),
    Shape("sites", "site", "", _OBJ, has="site"),
    Shape("sites", "site", "", _OBJ, children="other"),
    Shape("sites", "sites", "", _BOTH),
    Shape("claims", "group", "", _OBJ, has="group"),
    Shape("claims", "claims", "", (ARRAY,)),
    Shape("claims", "claims", "", _OBJ, lacks="claim", children="objects"),
    Shape("claims", "claim", "", _OBJ),
    Shape("group", "claim", "claims", _OBJ, has="naming", children="other"),
    Shape("group", "claims", "claims"),
)
_PART = {name: i for i, name in enumerate(dict.fromkeys(["", "root", *(s.part for s in SHAPES)]))}


class Shredder:
    """Adjacency columns of many payloads, in the order of writing; nodes are numbered over all of them."""

    def __init__(self) -> None:
        self.roots: list[int] = []
        self.parent: list[int] = []
        self.label: list[str | None] = []
        self.ordinal: list[int] = []
        self.kind: list[int] = []
        self.value: list[object] = []

    def add(self, text: str | None) -> bool:
        """Appends the nodes of one payload; False if it is null or not JSON. Strings that hold a JSON object
        or array are opened like the value they hold."""
        if text is None:
            return False
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return False
        self.roots.append(len(self.parent))
        stack = [(-1, None, 0, value)]
        pop, push, at = stack.pop, stack.append, len(self.parent)
        parents, labels, ordinals, kinds, values = self.parent.append, self.label.append, self.ordinal.append, self.kind.append, self.value.append
        while stack:
            parent, label, ordinal, v = pop()
            kind = _KIND[type(v)]
            if kind == STRING and v[:1] in "{[ \n\t\r" and v.lstrip()[:1] in ("{", "["):
                try:
                    v = json.loads(v)
                    kind = _KIND[type(v)]
                except (ValueError, RecursionError):
                    pass
            parents(parent)
            labels(label)
            ordinals(ordinal)
            kinds(kind)
            if kind == OBJECT:
                values(None)
                i = len(v)
                for k in reversed(v):
                    i -= 1
                    push((at, k, i, v[k]))
            elif kind == ARRAY:
                values(None)
                for i in range(len(v) - 1, -1, -1):
                    push((at, None, i, v[i]))
            else:
                values(v)
            at += 1
        return True

    def frame(self) -> pd.DataFrame:
        """(doc, node, parent, label, ordinal, kind, scalar), node and parent counted within each payload."""
        doc, base = self.owners()
        parent = np.array(self.parent, np.int64)
        scalar = [v if k == STRING else None if k <= NULL else json.dumps(v) for k, v in zip(self.kind, self.value)]
        return pd.DataFrame({"doc": doc, "node": np.arange(len(parent)) - base, "parent": np.where(parent < 0, -1, parent - base), "label": self.label, "ordinal": self.ordinal, "kind": [KINDS[k] for k in self.kind], "scalar": scalar})

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """The payload of each node, and its root."""
        roots = np.array(self.roots, np.int64)
        doc = np.repeat(np.arange(len(roots)), np.diff(np.r_[roots, len(self.parent)]))
        return doc, roots[doc] if len(roots) else doc


class Tree:
    """The adjacency columns as arrays with the joins the entities need."""

    def __init__(self, n: Shredder) -> None:
        self.n, size = n, len(n.parent)
        self.parent, self.kind = np.array(n.parent, np.int64), np.array(n.kind, np.int64)
        self.label = np.fromiter((_LABEL.get(x, 0) for x in n.label), np.int64, size)
        self.doc, _ = n.owners()
        inner = np.flatnonzero(self.parent >= 0)
        up = self.parent[inner]
        self.keys = np.zeros(size, np.int64)
        np.bitwise_or.at(self.keys, up, _BITS[self.label[inner]])
        self.count = np.bincount(up, minlength=size)
        plain = np.bincount(up, weights=self.kind[inner] <= NULL, minlength=size) - np.bincount(up, weights=self.kind[inner] == ARRAY, minlength=size)
        self.objects = (self.count > 0) & (plain == self.count)
        self.order = inner[np.argsort(up, kind="stable")]
        self.first = np.cumsum(self.count) - self.count
        self.part, self.owner = self._parts()

    def children(self, nodes: np.ndarray) -> np.ndarray:
        """All children of the nodes, node by node, each in the order of writing."""
        n = self.count[nodes]
        at = np.repeat(self.first[nodes] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return self.order[at]

    def _parts(self) -> tuple[np.ndarray, np.ndarray]:
        """The part each node plays, and the proposal it belongs to: level by level each node is joined with
        its parent's part and takes the first shape that fits."""
        size = len(self.parent)
        part, owner = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        level = np.flatnonzero(self.parent < 0)
        part[level] = _PART["root"]
        while len(level):
            level = self.children(level)
            under, label, kind = part[self.parent[level]], self.label[level], self.kind[level]
            keys, count, objects = self.keys[level], self.count[level], self.objects[level]
            found = np.zeros(len(level), np.int64)
            for s in SHAPES:
                ok = (found == 0) & (under == _PART[s.under])
                if not ok.any():
                    continue
                if s.label:
                    ok &= label == _LABEL[s.label]
                ok &= np.isin(kind, s.kinds)
                if s.has:
                    ok &= (keys & _BIT[s.has]) > 0
                if s.lacks:
                    ok &= (keys & _BIT[s.lacks]) == 0
                if s.children:
                    ok &= count == 0 if s.children == "none" else objects == (s.children == "objects")
                found[ok] = _PART[s.part]
            part[level] = found
            owner[level] = np.where(found == _PART["proposal"], level, owner[self.parent[level]])
            level = level[found > 0]
        return part, owner

    def entities(self, *parts: str) -> np.ndarray:
        return np.flatnonzero(np.isin(self.part, [_PART[p] for p in parts]))

    def positions(self) -> np.ndarray:
        """By node, the position of a proposal in its payload."""
        at = self.entities("proposal")
        out = np.full(len(self.parent), -1, np.int64)
        out[at] = _running(self.doc[at])
        return out

    def scalar(self, nodes: np.ndarray, label: str) -> np.ndarray:
        """By node of the tree, its child of that label, -1 for none; only for the given nodes."""
        out = np.full(len(self.parent), -1, np.int64)
        c = self.children(nodes)
        c = c[self.label[c] == _LABEL[label]]
        out[self.parent[c]] = c
        return out[nodes]

    def text(self, node: int) -> str | None:
        """A scalar as text; None for no node and for objects, arrays and nulls."""
        if node < 0 or self.kind[node] <= NULL:
            return None
        v = self.n.value[node]
        return v if isinstance(v, str) else json.dumps(v)

    def coordinates(self, node: int) -> tuple[int, int, int]:
        """The coordinates below a frac_coords node: a list, an object with x, y, z, or a text with three numbers."""
        if node < 0:
            return -1, -1, -1
        if self.kind[node] == STRING:
            return _coords(NUMBER.findall(self.n.value[node]))
        below = self.order[self.first[node] : self.first[node] + self.count[node]]
        if self.kind[node] == OBJECT:
            held = {self.n.label[i].lower(): self.text(i) for i in below}
            return _coords([held.get(a) for a in "xyz"] if held else [])
        return _coords([self.text(i) for i in below])


def _running(groups: np.ndarray) -> np.ndarray:
    """The number of earlier rows of the same group."""
    order = np.argsort(groups, kind="stable")
    g = groups[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    out = np.empty(len(groups), np.int64)
    out[order] = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return out


def _coords(values: list) -> tuple[int, int, int]:
    """Fractional coordinates times 10,000, rounded; -1 each unless there are exactly three numbers."""
    try:
        xyz = [float(v) for v in values]
    except (TypeError, ValueError, OverflowError):
        return -1, -1, -1
    if len(xyz) != 3 or not all(abs(v) < 1e14 for v in xyz):
        return -1, -1, -1
    return tuple(round(v * 10000) for v in xyz)


def _site_coords(t: Tree, nodes: np.ndarray) -> np.ndarray:
    """(x4, y4, z4) of frac_coords nodes; lists of three numbers are taken together, all else one by one."""
    out = np.full((len(nodes), 3), -1, np.int64)
    listed = (nodes >= 0) & (t.kind[nodes] == ARRAY) & (t.count[nodes] == 3)
    below = t.children(nodes[listed]).reshape(-1, 3)
    numeric = (t.kind[below] == NUMERIC).all(axis=1)
    plain = np.zeros(len(nodes), bool)
    plain[np.flatnonzero(listed)[numeric]] = True
    try:
        xyz = np.array([t.n.value[i] for i in below[numeric].ravel()], float).reshape(-1, 3)
    except OverflowError:
        plain[:] = False
    else:
        ok = (np.abs(xyz) < 1e14).all(axis=1)
        out[np.flatnonzero(plain)[ok]] = np.rint(xyz[ok] * 10000).astype(np.int64)
    for i in np.flatnonzero(~plain & (nodes >= 0)):
        out[i] = t.coordinates(nodes[i])
    return out


def _children_of(n: Shredder) -> dict[str, object]:
    """Columns of sites and claims: object nodes joined with their scalar children, in the order of writing."""
    t = Tree(n)
    at = t.entities("site", "claim")
    site = t.part[at] == _PART["site"]
    named = np.where(site, t.scalar(at, "element"), t.scalar(at, "name"))
    label = [t.text(i) for i in named]
    for i in np.flatnonzero(~site):
        # A claim without a name takes the key it stands under.
        if label[i] is None and n.label[at[i]] not in (None, "claims", "claimed_properties"):
            label[i] = n.label[at[i]]
    xyz = np.full((len(at), 3), -1, np.int64)
    xyz[site] = _site_coords(t, t.scalar(at[site], "frac_coords"))
    owner = t.owner[at]
    return {"doc": t.doc[at], "proposal_pos": t.positions()[owner], "child": np.where(site, "site", "claim"), "child_pos": _running(owner * 2 + site), "label": [x or "" for x in label], "x4": xyz[:, 0], "y4": xyz[:, 1], "z4": xyz[:, 2]}


def _parents_of(n: Shredder) -> dict[str, object]:
    """Columns of proposals, in the order of writing."""
    t = Tree(n)
    at = t.entities("proposal")
    inside = t.scalar(at, "composition")
    formula = np.full(len(at), -1, np.int64)
    formula[inside >= 0] = t.scalar(inside[inside >= 0], "formula")
    return {"doc": t.doc[at], "proposal_pos": t.positions()[at], "proposal_id": [t.text(i) for i in t.scalar(at, "proposal_id")], "formula": [t.text(i) for i in formula]}


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, Shredder]]:
    for pdf in batches:
        keys, nodes, size = [], Shredder(), 0
        for k, p in zip(pdf["k"], pdf["p"]):
            if nodes.add(p):
                keys.append(k)
            size += len(p or "")
            if size > CHUNK_CHARS:
                yield np.array(keys, dtype=pdf["k"].dtype), nodes
                keys, nodes, size = [], Shredder(), 0
        if keys:
            yield np.array(keys, dtype=pdf["k"].dtype), nodes


def _mapped(df: DataFrame, key: str, payload: str, columns_of, schema: str) -> DataFrame:
    """The rows columns_of makes of each chunk of payloads, under the key of their payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, nodes in _chunks(batches):
            out = pd.DataFrame(columns_of(nodes))
            if len(out):
                out.insert(0, "k", keys[out["doc"].to_numpy()])
                yield out.drop(columns="doc")

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(payload).alias("p")).where(F.col("p").isNotNull()).mapInPandas(run, f"k {kind}, {schema}").withColumnRenamed("k", key)


def shred(df: DataFrame, key: str, payload: str) -> DataFrame:
    """The adjacency table (key, node, parent, label, ordinal, kind, scalar) of every payload that is JSON.

    The root has parent -1. Null and unreadable payloads have no nodes."""
    return _mapped(df, key, payload, Shredder.frame, NODES)


def children(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, proposal_pos, child, child_pos, label, x4, y4, z4): sites and claims of every proposal.

    proposal_pos counts the proposals of the payload that are not null, child_pos the sites or the claims of
    the proposal across any grouping, both from 0 in the order of writing. Sites may stand in a list, under
    keys, in nested blocks, alone, or in a string of JSON; claims likewise, and a claim without a name takes
    the key it stands under. Coordinates may be a list, an object with x, y, z, or text; they are -1 each
    where there are not exactly three numbers, and for claims. A null or unreadable payload has no rows.
    """
    return _mapped(df, key, payload, _children_of, "proposal_pos int, child string, child_pos int, label string, x4 bigint, y4 bigint, z4 bigint")


def proposals(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, proposal_pos, proposal_id, formula): the parents of children(), one row per proposal."""
    return _mapped(df, key, payload, _parents_of, "proposal_pos int, proposal_id string, formula string")


def orphaned(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children whose (key, proposal_pos) has no parent row; none for tables of one payload column."""
    return child.join(parent.select(key, "proposal_pos"), [key, "proposal_pos"], "left_anti")
