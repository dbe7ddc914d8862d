"""A navigable small-world graph over token sets, kept to measure whether it could screen findings.

Each row is linked both ways to its nearest rows found by a greedy beam search at the time it is added; a
search starts from a few fixed rows and widens its beam. history.py does not use it: see README for the
recall it reaches on the messages of one proposal.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

import numpy as np


class SmallWorld:
    def __init__(self, *, links: int = 12, beam: int = 48, entries: int = 4) -> None:
        self.links, self.beam, self.entries = links, beam, entries
        self.sets: list[frozenset[str]] = []
        self.near: list[set[int]] = []
        self.compared = 0

    def _similarity(self, a: frozenset[str], i: int) -> float:
        self.compared += 1
        b = self.sets[i]
        common = len(a & b)
        return common / (len(a) + len(b) - common) if a or b else 0.0

    def search(self, tokens: frozenset[str], beam: int | None = None) -> list[tuple[float, int]]:
        """The rows met, most similar first, at most as many as the beam is wide."""
        width = self.beam if beam is None else beam
        if not self.sets:
            return []
        step = max(1, len(self.sets) // self.entries)
        seen = set(range(0, len(self.sets), step))
        best = [(self._similarity(tokens, i), i) for i in seen]
        heapq.heapify(best)
        front = [(-s, i) for s, i in best]
        heapq.heapify(front)
        while front:
            s, i = heapq.heappop(front)
            if len(best) >= width and -s < best[0][0]:
                break
            for j in self.near[i] - seen:
                seen.add(j)
                t = self._similarity(tokens, j)
                if len(best) < width or t > best[0][0]:
                    heapq.heappush(best, (t, j))
                    heapq.heappush(front, (-t, j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted(best, reverse=True)

    def add(self, tokens: frozenset[str]) -> None:
        found = self.search(tokens)[: self.links]
        me = len(self.sets)
        self.sets.append(tokens)
        self.near.append({i for _, i in found})
        for _, i in found:
            self.near[i].add(me)


def recall(rows: Sequence[frozenset[str]], beams: Sequence[int], *, share: float = 0.75, queries: int = 400, seed: int = 1, **settings: int) -> list[tuple[int, float, float]]:
    """(beam, recall, comparisons per query) of finding any earlier row that shares `share`, against exhaustive
    search, over a bounded sample of the rows that have one."""
    graph = SmallWorld(**settings)
    for r in rows:
        graph.add(r)
    similar = lambda a, b: len(a & b) >= share * len(a | b) > 0
    order = np.random.default_rng(seed).permutation(len(rows))
    wanted = []
    for q in order:
        if len(wanted) == queries:
            break
        if any(similar(rows[q], rows[i]) for i in range(len(rows)) if i != q):
            wanted.append(int(q))
    out = []
    for beam in beams:
        graph.compared = 0
        hit = sum(any(s >= share and i != q for s, i in graph.search(rows[q], beam)) for q in wanted)
        out.append((beam, hit / max(1, len(wanted)), graph.compared / max(1, len(wanted))))
    return out


def screened(rows: Iterable[tuple[int, str, str | None, frozenset[str]]], beam: int, *, share: float = 0.75, **settings: int) -> tuple[list[tuple[int, int]], int]:
    """((old_id, new_id) pairs, comparisons) of (id, proposal, fingerprint, tokens) rows taken by id, one graph of
    accepted rows per proposal as the screen, the rule itself on what the screen lets through."""
    graphs: dict[str, SmallWorld] = {}
    ids: dict[str, list[int]] = {}
    prints: dict[tuple[str, str], int] = {}
    out = []
    for i, proposal, fp, tokens in rows:
        graph = graphs.setdefault(proposal, SmallWorld(**settings))
        met = [ids[proposal][j] for s, j in graph.search(tokens, beam) if s >= share] if tokens else []
        if (proposal, fp) in prints:
            met.append(prints[proposal, fp])
        if met:
            out.append((min(met), i))
            continue
        if fp is not None:
            prints[proposal, fp] = i
        if tokens:
            graph.add(tokens)
            ids.setdefault(proposal, []).append(i)
    return out, sum(g.compared for g in graphs.values())
