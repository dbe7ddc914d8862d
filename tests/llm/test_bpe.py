from __future__ import annotations

import random
from pathlib import Path

import pytest

from orefold.llm import bpe

FILE = Path(bpe.TOKENIZERS) / "byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not FILE.exists(), reason="no tokenizer files here")
TEXTS = ["", " ", "  \n\n x", "don't they're I'LL", "a" * 3000, "abab" * 500, "<|endoftext|>", "日本 é ñ ￿", "\x00\x01", "naïve café—x", "1234567890 12.5e-7", "​ x", "aaa aaaa aaaaa", "x" * 100_000]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(FILE))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_equals_the_library(library):
    rnd = random.Random(1)
    alphabet = "abcdeth  \n.,'1290éßж日🎉-_\t"
    texts = TEXTS + ["".join(rnd.choices(alphabet, k=rnd.randrange(1, 400))) for _ in range(300)]
    assert bpe.Encoder(bpe.read_merges(str(FILE))).encode(texts) == library(texts)


def test_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 5)
    e = bpe.Encoder(bpe.read_merges(str(FILE)))
    for part in (["one two three four five six"], ["six seven eight one"], ["two two"]):
        assert e.encode(part) == library(part)


def test_frame(spark, library, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (99, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "text AS k", "doc_id AS t", "1 AS ids")
    got = bpe.encode(df, "doc_id", "text", str(FILE)).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted([*zip(range(len(TEXTS)), library(TEXTS)), (99, []), (99, [])])
    assert bpe.encode(df.limit(0), "doc_id", "text", str(FILE)).count() == 0
    assert dict(bpe.encode(df, "doc_id", "text", str(FILE)).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}


def test_overlapping_pairs_merge_from_the_left():
    import numpy as np

    m = bpe.Merges(np.array([0 * int(bpe.SPAN) + 0]), np.array([0]), np.array([7]), np.arange(256) * 0)
    assert [w.tolist() for w in bpe.encode_words([b"xxx", b"xxxx", b"", b"x"], m)] == [[7, 0], [7, 7], [], [0]]
