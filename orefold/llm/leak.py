"""Evaluation texts in training texts: a generalised suffix automaton of the items, streamed over the corpus."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.session import cut, scratch, stored

#: Fixed value of the problem: so many consecutive words of an item make a leak.
LENGTH = 10
#: A document with this share of its words inside leaked spans is dropped, not cleaned.
COVERAGE = 0.5
#: Bytes one automaton may take in a worker; more items are searched in several passes, each with its own.
PACK_BYTES = 192 << 20
#: Bytes a word of an item takes at most, all states and edges counted: measured in the tests.
WORD_BYTES = 640
WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased one by one."""
    if not text:
        return []
    return WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


class Automaton:
    """Every word sequence of every item is a path; a state of `length` words and more knows the items it stands in.

    Edges lie in one table keyed by state and word, states in flat arrays; an automaton travels as arrays and
    its table of edges is made again where it arrives."""

    def __init__(self, items: Sequence[tuple[int, str | None]], length: int = LENGTH) -> None:
        self.vocab: dict[str, int] = {}
        self.length = length
        self.edge: dict[int, int] = {}
        self.link, self.len = array("i", [-1]), array("i", [0])
        self._out: list[list[int]] = [[]]
        told: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            path = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in words(text))
            if len(path) >= length:
                told.setdefault(path, []).append(item)
        for path in told:
            last = 0
            for w in path:
                last = self._extend(last, w)
        del self._out
        held: dict[int, set[int]] = {}
        for path, ids in told.items():
            state = 0
            for w in path:
                state = self.edge[state << 32 | w]
                if self.len[state] >= length:
                    held.setdefault(self._least(state), set()).update(ids)
        self.items = {s: tuple(sorted(h)) for s, h in held.items()}

    def __getstate__(self) -> dict:
        keys = np.fromiter(self.edge, np.int64, len(self.edge))
        return {"vocab": [*self.vocab], "length": self.length, "keys": keys, "to": np.fromiter(self.edge.values(), np.int32, len(keys)), "link": self.link, "len": self.len, "items": self.items}

    def __setstate__(self, s: dict) -> None:
        self.vocab, self.length, self.link, self.len, self.items = {w: i for i, w in enumerate(s["vocab"])}, s["length"], s["link"], s["len"], s["items"]
        self.edge = dict(zip(s["keys"].tolist(), s["to"].tolist()))

    def size(self) -> int:
        """Bytes of the tables as they lie in a worker."""
        parts = (self.vocab, self.edge, self.link, self.len, self.items, *self.vocab, *self.items.values())
        return sum(map(sys.getsizeof, parts)) + 28 * 2 * len(self.edge)

    def _least(self, state: int) -> int:
        """The shortest sequence of at least `length` words that ends where the state's do."""
        while self.len[self.link[state]] >= self.length:
            state = self.link[state]
        return state

    def _state(self, length: int, link: int) -> int:
        self.link.append(link)
        self.len.append(length)
        self._out.append([])
        return len(self.len) - 1

    def _set(self, p: int, w: int, q: int) -> None:
        self.edge[p << 32 | w] = q

    def _clone(self, p: int, q: int, w: int) -> int:
        c = self._state(self.len[p] + 1, self.link[q])
        for x in self._out[q]:
            self._set(c, x, self.edge[q << 32 | x])
        self._out[c] = self._out[q][:]
        self.link[q] = c
        while p >= 0 and self.edge.get(p << 32 | w) == q:
            self._set(p, w, c)
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.edge.get(last << 32 | w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, w)
        new, p = self._state(self.len[last] + 1, 0), last
        while p >= 0 and (p << 32 | w) not in self.edge:
            self._set(p, w, new)
            self._out[p].append(w)
            p = self.link[p]
        if p >= 0:
            q = self.edge[p << 32 | w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, w)
        return new

    def scan(self, tokens: Sequence[str]) -> tuple[set[int], list[tuple[int, int]]]:
        """Items leaked and the leaked spans of word positions, end excluded, merged where they touch."""
        edge, link, length, least = self.edge.get, self.link, self.len, self.length
        get, state, l = self.vocab.get, 0, 0
        found: set[int] = set()
        spans: list[tuple[int, int]] = []
        for at, token in enumerate(tokens):
            w = get(token)
            if w is None:
                state = l = 0
                continue
            to = edge(state << 32 | w)
            while to is None and state:
                state = link[state]
                l = length[state]
                to = edge(state << 32 | w)
            if to is None:
                continue
            state, l = to, l + 1
            if l >= least:
                found.update(self.items.get(self._least(state), ()))
                if spans and spans[-1][1] >= at + 1 - l:
                    spans[-1] = (min(spans[-1][0], at + 1 - l), at + 1)
                else:
                    spans.append((at + 1 - l, at + 1))
        return found, spans


@dataclass
class _Items:
    """Distinct item texts in packs; only their number and words are known to the driver beforehand."""

    texts: DataFrame
    packs: int
    repeated: bool

    def __iter__(self) -> Iterator[list[tuple[int, str]]]:
        for i in range(self.packs):
            part = self.texts.where(F.pmod(F.xxhash64("text"), F.lit(self.packs)) == i) if self.packs > 1 else self.texts
            if pack := [(r["rep"], r["text"]) for r in part.select("rep", "text").collect()]:
                yield pack


def _packed(items: DataFrame, item_id: str, text: str, length: int) -> _Items:
    """The distinct texts of at least `length` words, each under its smallest id, in packs whose automata stay
    below PACK_BYTES. A text of more words than a pack may hold has a pack of its own or shares one."""
    n_words = F.size(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("id"), F.col(text).alias("text")).withColumn("words", n_words).where(F.col("words") >= length)
    texts = rows.groupBy("text").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"))
    total, many = texts.agg(F.sum("words"), F.max("n")).first()
    return _Items(texts, 1 + (total or 0) * WORD_BYTES // PACK_BYTES, (many or 0) > 1)


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, *, length: int = LENGTH) -> DataFrame:
    """(doc_id, item_id): one row if any `length` consecutive words of the item follow one another in the text.

    Whole texts are streamed. Null and empty texts and items with fewer words leak nothing; equal items each
    have their row. The automaton of a pack of items, whose size is bounded, is sent to the executors; a
    larger item table is searched pack by pack.
    """
    known = _packed(items, item_id, item_text, length)
    kind = items.schema[item_id].dataType.simpleString()
    hit = lambda auto, k, tokens: [(k, item) for item in auto.scan(tokens)[0]]
    found = _each_pack(docs, doc_id, text, known, length, f"doc {docs.schema[doc_id].dataType.simpleString()}, rep {kind}", hit)
    if known.repeated:
        again = known.texts.where("n > 1").select("text", "rep").join(items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")), "text").select("rep", "id")
        found = found.join(again, "rep", "left").select("doc", F.coalesce("id", "rep").alias("rep"))
    return found.select(F.col("doc").alias(doc_id), F.col("rep").alias(item_id))


def _each_pack(docs: DataFrame, doc_id: str, text: str, known: _Items, length: int, schema: str, rows_of: Callable) -> DataFrame:
    """The rows that rows_of(automaton, key, words) yields, pack by pack; a task holds one automaton."""
    spark, out = docs.sparkSession, None
    texts = docs.where(F.col(text).isNotNull()).select(doc_id, text)
    names = [c.split()[0] for c in schema.split(", ")]
    for pack in known:
        shared = spark.sparkContext.broadcast(Automaton(pack, length))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            auto = shared.value
            for pdf in batches:
                found = [r for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]) if t for r in rows_of(auto, k, words(t))]
                yield pd.DataFrame(found, columns=names) if found else pd.DataFrame({n: [] for n in names})

        part = texts.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def cleaned(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, *, length: int = LENGTH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, words, leaked_words, dropped, text): every document without its leaked spans.

    A document of whose words at least `coverage` leaked is dropped (text null); a null text stays null. With
    several packs the spans of each are found on their own and written before they come together; rows of one
    id are then taken to be one document."""
    known = _packed(items, item_id, item_text, length)
    kind = docs.schema[doc_id].dataType.simpleString()
    out = f"{doc_id} {kind}, words int, leaked_words int, dropped boolean, text string"
    if known.packs == 1:
        pack = next(iter(known), [])
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(pack, length))

        def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            auto = shared.value
            for pdf in batches:
                rows = [_cleaned(k, t, auto.scan(words(t))[1], coverage) for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1])]
                yield pd.DataFrame(rows, columns=[doc_id, "words", "leaked_words", "dropped", "text"])

        return docs.select(doc_id, text).mapInPandas(once, out)

    spans_of = lambda auto, k, tokens: [(k, a, b) for a, b in auto.scan(tokens)[1]]
    with scratch(docs.sparkSession) as work:
        spans = stored(_each_pack(docs, doc_id, text, known, length, f"doc {kind}, a int, b int", spans_of), f"{work}/spans")
        per = cut(spans.distinct().groupBy(F.col("doc").alias("_of")).agg(F.collect_list(F.struct("a", "b")).alias("_spans")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_cleaned(k, t, [] if s is None else [(x["a"], x["b"]) for x in s], coverage) for k, t, s in zip(pdf["_id"], pdf["_text"], pdf["_spans"])]
            yield pd.DataFrame(rows, columns=[doc_id, "words", "leaked_words", "dropped", "text"])

    told = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(per, F.col("_id") == F.col("_of"), "left").select("_id", "_text", "_spans")
    return told.mapInPandas(run, out)


def _cleaned(key: int, text: str | None, spans: Sequence[tuple[int, int]], coverage: float) -> tuple:
    """One row of cleaned()."""
    if not spans:
        return key, len(words(text)), 0, False, text
    found = [*WORD.finditer(text)]
    bad = {i for a, b in spans for i in range(a, b)}
    drop = len(bad) >= coverage * len(found)
    return key, len(found), len(bad), drop, None if drop else _without(text, found, bad)


def _without(text: str, found: list, bad: set[int]) -> str:
    out, at = [], 0
    for i, m in enumerate(found):
        if i in bad:
            if i - 1 not in bad:
                out.append(text[at : m.start()])
            at = m.end()
    return "".join(out) + text[at:]
