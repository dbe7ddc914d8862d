"""Reading level of each document: a linear pairwise ranker over syntax and vocabulary features of sentences,
calibrated into levels by isotonic regression.

The ranker learns from pairs of graded documents which of two is harder. A document's score is the median
of its sentences' scores, so that short insertions do not move it. Which texts have a level at all is learned
from the graded documents too: how their letters follow one another, and what share of their tokens are words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.session import cut

#: Graded documents the ranker is fitted on, at most: those with the smallest hash of their id.
SAMPLE_DOCS = 4000
#: Pairs drawn from them, at most.
PAIRS = 60_000
#: Fixed value of the problem: texts with fewer words have no level.
LEAST_WORDS = 30
#: A text is prose if its share of words reaches this part of what 99 of 100 graded documents reach.
PROSE_PART = 0.75
#: Counts a letter pair, and a single letter, lend to the estimate of what follows them.
PRIOR = (50.0, 20.0)
#: Share of the graded documents below which a step of the calibration is joined with its neighbour.
LEAST_BLOCK = 0.02
#: Calibrated levels from here on are nearer to 4 than to 3.
HARD = 3.5
#: Words are counted over all documents in this many hashed buckets: a table of fixed size for any corpus.
BUCKETS = 1 << 16
#: Characters of text turned into features at a time, and words a worker remembers.
GROUP_CHARS, MEMORY_WORDS = 1 << 21, 1 << 17

#: Words that open a subordinate clause or tie clauses together.
CLAUSE_WORDS = frozenset("that which who whom whose whether although though since because if unless until while whereas where when before after than as inasmuch notwithstanding namely so but nor yet however consequently".split())
# Abbreviations whose point ends no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "cf.", "ca.", "vs.", "fig.", "no.", "approx.", "etc.", "resp.", "dr.", "eq.", "tab.", "ref.", "et al.")
_ABBREVIATION = re.compile(r"\b(" + "|".join(re.escape(a[:-1]) for a in ABBREVIATIONS) + r")\.", re.I)
_LIST = re.compile(r"^\s*(?:[-*•>|]+|\(?\d{1,3}[.)]|[a-z]\))\s+", re.M)
_SPLIT = re.compile(r"(?<=[.!?])[\"'”’)]*\s+|\n\s*\n|\n")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_APART = re.compile(r"(?<![\w])[^\W\d_]+(?:['’][^\W\d_]+)?(?![\w])")
_DIGIT = re.compile(r"\d")
_PROSE = re.compile(r"^[(\"'“‘\[]*[^\W\d_]+(?:[-'’][^\W\d_]+)*[)\"'”’\]]*[.,;:!?…]*$")
_BULLET = re.compile(r"^(?:[-*•>|]+|\(?\d{1,3}[.)])$")
_BROKEN = re.compile(r"(?<=[^\s.!?:])[ \t]*\n(?=[ \t]*[a-zß-ÿ])")
_VOWELS = re.compile(r"[aeiouy]+")
_LATINATE = re.compile(r"(?:tion|sion|ity|ical|ally|ence|ance|ment|ous|ive|ise|ises|ised|ising|ation|ical|ably|ible|able|ate|ates|ology|metry|scopic|metric|esis|ancy|ency)s?$")
FEATURES = ("length", "length_squared", "letters", "long", "very_long", "syllables", "latinate", "clauses", "commas", "easy", "length_letters", "length_long", "clause_share", "letters_squared", "rarity")


def sentences(text: str) -> list[str]:
    """Sentences of a text whatever its layout: marks of lists and quotes are dropped, a line that ends a
    sentence or is followed by a new one ends there, and a line broken inside a sentence is joined again."""
    t = _LIST.sub("", text.replace("\r\n", "\n").replace("\r", "\n").replace("\u200b", ""))
    low = t.lower()
    if any(map(low.__contains__, ABBREVIATIONS)):
        t = _ABBREVIATION.sub(lambda m: m[1].replace(".", "") + " ", t)
    if "\n" in t and not (t.isupper() or t.islower()):
        t = _BROKEN.sub(" ", t)
    return [s for s in (p.strip() for p in _SPLIT.split(t)) if s]


# Letters of a text as classes: 0 for all between words, 1 to 26, 27 for letters beyond a-z.
_CLASSES = bytes(i - 96 if 97 <= i <= 122 else 27 if i >= 128 else 0 for i in range(256))
LETTERS = 28


def triples(text: str) -> np.ndarray:
    """Each run of three letter classes as one number; signs and digits are gaps, and gaps count once."""
    low = text.lower()
    if not low.isascii():
        low = re.sub(r"[^\w\s]", " ", low)
    c = np.frombuffer(low.encode("utf-8", "replace").translate(_CLASSES), np.uint8).astype(np.int32)
    if len(c) < 3:
        return np.zeros(0, np.int32)
    c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
    return c[:-2] * LETTERS**2 + c[1:-1] * LETTERS + c[2:]


@dataclass(frozen=True)
class Gate:
    """gain: for each run of three letters how much better the graded documents' letter sequences explain the
    last one than their letter frequencies do; least: the share of words from which on a text is prose."""

    gain: np.ndarray
    least: float

    def speaks(self, text: str) -> bool:
        """Whether the letters follow one another as in the graded documents, rather than in any order."""
        t = triples(text)
        return bool(len(t)) and float(self.gain[t].mean()) > 0


def gate(counts: np.ndarray, shares: Sequence[float]) -> Gate:
    """The gate from counts of letter runs and word shares of graded documents."""
    c = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
    one = (c.sum((0, 1)) + 1) / (c.sum() + LETTERS)
    pairs = c.sum(0)
    two = (pairs + PRIOR[1] * one) / (pairs.sum(1, keepdims=True) + PRIOR[1])
    three = (c + PRIOR[0] * two[None]) / (c.sum(2, keepdims=True) + PRIOR[0])
    return Gate(np.log(three / one).ravel().astype(np.float32), PROSE_PART * float(np.quantile(shares, 0.01)) if len(shares) else 1.0)


class _Remembered(dict):
    """Values by key, made where missing; emptied when it has grown too large."""

    def __init__(self, make: Callable[[str], object]) -> None:
        self.make = make

    def __missing__(self, key: str) -> object:
        if len(self) > MEMORY_WORDS:
            self.clear()
        value = self[key] = self.make(key)
        return value


_PROSE_ONE = 1 << 32


def _token_kind(token: str) -> int:
    """0 for the mark of a list, 1 for any token, and 1 << 32 besides for one that reads as a word."""
    return 0 if _BULLET.match(token) else 1 + _PROSE_ONE * (_PROSE.match(token) is not None)


class Reader:
    """Turns texts into features of their sentences, many texts at a time."""

    def __init__(self, weights: bytes) -> None:
        self.weights = weights
        self.kinds = _Remembered(_token_kind)
        self.known: dict[str, int] = {}
        self.stats = np.zeros((0, 8))

    def share(self, text: str) -> tuple[float, bool]:
        """(share of words among the tokens, whether there are words enough)."""
        total = sum(map(self.kinds.__getitem__, text.split()))
        n, words = total % _PROSE_ONE, total // _PROSE_ONE
        return words / n if n else 0.0, words >= LEAST_WORDS or len(_WORD.findall(text)) >= LEAST_WORDS

    def _word(self, w: str) -> tuple[float, ...]:
        n = len(w)
        bucket = xxhash.xxh64_intdigest(re.split("['’]", w)[0].encode("utf-8", "replace"), 42)
        bucket = (bucket - (1 << 64) if bucket >= 1 << 63 else bucket) % BUCKETS
        return n, n >= 7, n >= 11, n <= 4, max(1, len(_VOWELS.findall(w))), n > 5 and _LATINATE.search(w) is not None, w in CLAUSE_WORDS, self.weights[bucket] / 8

    def _ids(self, words: list[str]) -> np.ndarray:
        fresh = [*dict.fromkeys(w for w in words if w not in self.known)]
        if len(self.known) + len(fresh) > MEMORY_WORDS:
            self.known, self.stats, fresh = {}, self.stats[:0], [*dict.fromkeys(words)]
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.stats = np.vstack([self.stats, np.array([self._word(w) for w in fresh], float)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def features(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, features) of every sentence of three and more words, without regard to letter
        case. Formulas and codes are no words of the language: letters that touch digits are left out."""
        words: list[str] = []
        owner, size, commas = [], [], []
        for i, text in enumerate(texts):
            for s in sentences(text):
                found = (_APART if _DIGIT.search(s) else _WORD).findall(s.lower())
                if len(found) > 2:
                    words += found
                    owner.append(i)
                    size.append(len(found))
                    commas.append(s.count(",") + s.count(";"))
        if not owner:
            return np.zeros(0, np.int64), np.zeros((0, len(FEATURES)))
        n = np.array(size, float)
        sums = np.add.reduceat(self.stats_of(words), np.r_[0, np.cumsum(size)[:-1]], axis=0)
        letters, long, very, easy, syllables, latinate, clauses, rarity = (sums / n[:, None]).T
        length = np.log(n)
        x = [length, length**2, letters, long, very, syllables, latinate, np.log1p(clauses * n), np.log1p(np.array(commas, float)), easy, length * letters, length * long, clauses, letters**2, rarity]
        return np.array(owner, np.int64), np.stack(x, axis=1)

    def stats_of(self, words: list[str]) -> np.ndarray:
        ids = self._ids(words)
        return self.stats[ids]

    def judged(self, texts: Sequence[str | None], gate_: Gate) -> list[int]:
        """The positions of texts that have a level: prose in the language of the graded documents, long enough."""
        out = []
        for i, t in enumerate(texts):
            if t:
                share, enough = self.share(t)
                if enough and share >= gate_.least and gate_.speaks(t):
                    out.append(i)
        return out


def medians(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The median of the values of each owner 0..n-1; NaN for one without any."""
    order = np.lexsort((values, owner))
    v, sizes = values[order], np.bincount(owner, minlength=n)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.full(n, math.nan)
    some = sizes > 0
    a, b = starts[some] + (sizes[some] - 1) // 2, starts[some] + sizes[some] // 2
    out[some] = (v[a] + v[b]) / 2
    return out


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: Isotonic steps: scores from knots[i] on have level levels[i].
    knots: np.ndarray
    levels: np.ndarray

    def scores(self, owner: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """The median score of the sentences of each of n texts."""
        return medians(owner, (rows - self.mean) / self.scale @ self.weights, n)

    def level(self, scores: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(scores), np.nan, np.interp(scores, self.knots, self.levels))


def isotonic(x: np.ndarray, y: np.ndarray, *, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the centre and mean of each block of a non-decreasing fit of y over x.

    Blocks with less than the share `least` of the points, which stand for a few readers' errors where two
    levels meet, are joined with the neighbour of the nearer mean, the smallest first."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []

    def join(i: int) -> None:
        a, b = blocks[i], blocks.pop(i + 1)
        n = a[1] + b[1]
        blocks[i] = [(a[0] * a[1] + b[0] * b[1]) / n, n, (a[2] * a[1] + b[2] * b[1]) / n]

    for xi, yi in zip(x[order], y[order]):
        blocks.append([yi, 1.0, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            join(len(blocks) - 2)
    while len(blocks) > 1:
        i = min(range(len(blocks)), key=lambda k: (blocks[k][1], k))
        if blocks[i][1] >= least * len(x):
            break
        left = blocks[i][0] - blocks[i - 1][0] if i else math.inf
        right = blocks[i + 1][0] - blocks[i][0] if i + 1 < len(blocks) else math.inf
        join(i - 1 if left <= right else i)
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


def fit(x: np.ndarray, levels: np.ndarray, *, seed: int = 7, steps: int = 400, pairs: int = PAIRS) -> Ranker:
    """Learns the ranker, not yet calibrated, from graded documents by logistic loss over pairs of other level.

    x holds for each document the median of each feature over its sentences."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, len(z), (2, 4 * pairs))
    apart = levels[i] - levels[j] >= 0.5
    i, j = i[apart][:pairs], j[apart][:pairs]
    d, gap = z[i] - z[j], np.minimum(levels[i] - levels[j], 2.0)
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        g = -(gap * p) @ d / max(1, len(d)) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Ranker(mean, scale, w, np.zeros(1), np.zeros(1))


def calibrated(ranker: Ranker, scores: np.ndarray, levels: np.ndarray) -> Ranker:
    """The ranker with the isotonic steps from scores to levels."""
    return Ranker(ranker.mean, ranker.scale, ranker.weights, *isotonic(scores, levels, least=LEAST_BLOCK))


def word_weights(docs: DataFrame, text: str) -> bytes:
    """One byte per bucket: eight times the binary logarithm of how many documents there are to one that holds a
    word of the bucket. Counted over all documents; one row per bucket comes to the driver."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\p{L}+)"), F.lit(1)))
    counted = docs.select(F.explode(runs).alias("w")).groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).count().collect()
    n = max([c for _, c in counted], default=1)
    out = bytearray([min(255, int(8 * math.log2(1 + n)))]) * BUCKETS
    for b, c in counted:
        out[b] = min(255, int(8 * math.log2(1 + n / c)))
    return bytes(out)


@dataclass(frozen=True)
class Model:
    ranker: Ranker
    gate: Gate
    weights: bytes


def train(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_doc: str, level: str, *, sample: int = SAMPLE_DOCS) -> Model | None:
    """The model of the graded documents; None if no two of them differ in level.

    A document's grade is the median of its readers' grades. At most `sample` graded documents are used; of
    each only its grade, its share of words, one number per feature and its score come to the driver."""
    graded = labels.where(F.col(level).isNotNull() & F.col(label_doc).isNotNull()).groupBy(F.col(label_doc).alias("d")).agg(F.expr(f"percentile({level}, 0.5)").alias("y"))
    chosen = graded.orderBy(F.xxhash64("d"), "d").limit(sample)
    texts = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    rows = cut(texts.join(F.broadcast(chosen), "d"))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, counts, shares = Reader(bytes(BUCKETS)), np.zeros(LETTERS**3, np.int64), []
        for pdf in batches:
            for t in pdf["t"]:
                share, enough = reader.share(t)
                if enough:
                    shares.append(share)
                    counts += np.bincount(triples(t), minlength=LETTERS**3)
        yield pd.DataFrame({"counts": [counts], "shares": [shares]})

    met = rows.select("t").coalesce(8).mapInPandas(seen, "counts array<bigint>, shares array<double>").collect()
    pass_ = gate(np.sum([np.array(r.counts) for r in met] or [np.zeros(LETTERS**3)], axis=0), sorted(x for r in met for x in r.shares))
    weights = word_weights(docs, text)

    def middle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(weights)
        for pdf in batches:
            at = reader.judged(pdf["t"].tolist(), pass_)
            owner, x = reader.features([pdf["t"].iloc[i] for i in at])
            m = np.stack([medians(owner, x[:, j], len(at)) for j in range(len(FEATURES))], axis=1)
            ok = ~np.isnan(m).any(axis=1)
            yield pd.DataFrame({"y": pdf["y"].to_numpy()[at][ok], "x": list(m[ok])})

    points = sorted((r.y, *r.x) for r in rows.select("y", "t").mapInPandas(middle, "y double, x array<double>").collect())
    y = np.array([p[0] for p in points], float)
    if len({*y}) < 2:
        return None
    ranker = fit(np.array([p[1:] for p in points]), y)
    scored = sorted((r.y, r.s) for r in _scored(rows.select("y", "t"), "y", "t", Model(ranker, pass_, weights), "s").where(~F.isnan("s")).collect())
    ranker = calibrated(ranker, np.array([s for _, s in scored]), np.array([y for y, _ in scored]))
    return Model(ranker, pass_, weights)


def _scored(docs: DataFrame, key: str, text: str, model: Model, name: str, *, as_level: bool = False) -> DataFrame:
    """(key, name): the score or level of each text, NaN for one that has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model.weights)
        for pdf in batches:
            keys, texts = pdf.iloc[:, 0], pdf.iloc[:, 1].tolist()
            out, at, size = np.full(len(texts), math.nan), [], 0
            for i in [*reader.judged(texts, model.gate), -1]:
                if at and (i < 0 or size > GROUP_CHARS):
                    owner, x = reader.features([texts[j] for j in at])
                    s = model.ranker.scores(owner, x, len(at))
                    out[at] = model.ranker.level(s) if as_level else s
                    at, size = [], 0
                if i >= 0:
                    at.append(i)
                    size += len(texts[i])
            yield pd.DataFrame({key: keys, name: out})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, {name} double")


def levels(docs: DataFrame, doc_id: str, text: str, model: Model | None) -> DataFrame:
    """(doc_id, level): the calibrated level of each document; null where the text is null, too short, no
    prose or not in the language of the graded documents, and everywhere without a model. Equal texts get
    equal levels."""
    if model is None:
        return docs.select(doc_id, F.lit(None).cast("double").alias("level"))
    out = _scored(docs, doc_id, text, model, "level", as_level=True)
    return out.withColumn("level", F.when(~F.isnan("level"), F.col("level")))
