"""Byte-level BPE of a whole corpus by batched merge rounds in numpy.

The distinct words of a batch lie as symbols in one flat array. In each round the rank of every adjacent
pair is found by binary search over the sorted pair keys, each word's lowest rank by a segmented minimum,
and all words merge their lowest pair at once, until no word has a pair left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizer files lie; always a parameter.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public word pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers; more are encoded again, with the same result.
MEMORY_WORDS = 200_000
SPAN = np.int64(1 << 20)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 stands for itself, the
    other bytes take the code points from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass(frozen=True)
class Merges:
    """Sorted pair keys with the rank and the merged id of each pair, and the id of each byte."""

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    bytes_: np.ndarray


def read_merges(path: str) -> Merges:
    """The merges of a byte-level BPE file; about 50,000 rows, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, letters = model["vocab"], byte_letters()
    pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    keys = np.array([vocab[a] * int(SPAN) + vocab[b] for a, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    ids = np.zeros(256, np.int64)
    for ch, b in letters.items():
        ids[b] = vocab[ch]
    return Merges(keys[order], np.arange(len(keys), dtype=np.int64)[order], merged[order], ids)


NONE = np.int64(1 << 40)


def encode_words(words: list[bytes], m: Merges) -> list[np.ndarray]:
    """Ids of each word; an empty word has none."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = m.bytes_[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
    done_symbols, done_owner = [], []
    while len(symbols):
        key = symbols[:-1] * SPAN + symbols[1:]
        at = np.searchsorted(m.keys, key)
        at[at == len(m.keys)] = 0
        rank = np.where((m.keys[at] == key) & (owner[:-1] == owner[1:]), m.ranks[at], NONE)
        rank = np.append(rank, NONE)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(owner)])
        lowest = np.minimum.reduceat(rank, starts)
        per = np.repeat(lowest, sizes)
        finished = per == NONE
        if finished.any():
            done_symbols.append(symbols[finished])
            done_owner.append(owner[finished])
            live = ~finished
            if not live.any():
                break
            symbols, owner, rank, per, at = symbols[live], owner[live], rank[live], per[live], np.append(at, 0)[live]
        else:
            at = np.append(at, 0)
        hit = rank == per
        # A pair of two equal symbols overlaps itself in a run; the run merges from its left end, two by two.
        place = np.flatnonzero(hit)
        fresh = np.r_[True, np.diff(place) != 1]
        run = place - place[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        place = place[run % 2 == 0]
        symbols[place] = m.merged[at[place]]
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    if not done_symbols:
        return [np.zeros(0, np.int64)] * len(words)
    owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
    order = np.argsort(owner, kind="stable")
    return np.split(symbols[order], np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])


class Encoder:
    def __init__(self, merges: Merges) -> None:
        self.merges, self.split, self.memory = merges, regex.compile(PATTERN), {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text, unchanged and without special tokens; empty for an empty and for a null text."""
        split = [self.split.findall(t) if t else () for t in texts]
        fresh = [*{w for ws in split for w in ws if w not in self.memory}]
        known = self.memory
        if fresh:
            ids = encode_words([w.encode("utf-8", "surrogatepass") for w in fresh], self.merges)
            if len(known) + len(fresh) > MEMORY_WORDS:
                self.memory = known = {w: known[w] for ws in split for w in ws if w in known}
            for w, i in zip(fresh, ids):
                known[w] = i.tolist()
        return [[i for w in ws for i in known[w]] for ws in split]


#: Characters encoded at a time within a batch.
GROUP_CHARS = 1 << 22


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids): one row per row of df. Only the merge table, of fixed size, is sent to the executors."""
    shared = df.sparkSession.sparkContext.broadcast(read_merges(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for pdf in batches:
            keys, texts, size = [], [], 0
            for k, t in zip(pdf["k"], pdf["t"]):
                keys.append(k)
                texts.append(t)
                size += len(t or "")
                if size > GROUP_CHARS:
                    yield pd.DataFrame({"k": keys, "ids": encoder.encode(texts)})
                    keys, texts, size = [], [], 0
            if keys:
                yield pd.DataFrame({"k": keys, "ids": encoder.encode(texts)})

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, ids array<int>")
    return out.withColumnRenamed("k", key)
