from __future__ import annotations

import pickle
import random

import pytest

from orefold.llm import leak


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = leak.words(t)
        for j in range(len(w) - n + 1):
            grams.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leak.words(t)
        for j in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[j : j + n]), ())}
    return sorted(out)


def test_words():
    assert leak.words("Ab-c 1_2 É́x") == ["ab", "c", "1", "2", "é", "x"] and leak.words(None) == leak.words("") == []


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_brute_force(seed):
    rnd = random.Random(seed)
    items = [(i, " ".join(rnd.choices("abcd", k=rnd.randrange(0, 25)))) for i in range(12)] + [(20, "a a a a a a"), (21, "a a a a a a")]
    docs = [(d, " ".join(rnd.choices("abcde", k=rnd.randrange(0, 60)))) for d in range(30)]
    auto = leak.Automaton(items, 4)
    got = sorted((d, i) for d, t in docs for i in auto.scan(leak.words(t))[0])
    assert got == brute(docs, items, 4)


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def test_leaks(spark):
    docs = [(1, f"x {ITEM.upper().replace(' ', ' -- ')} y"), (2, ITEM.rsplit(" ", 3)[0]), (3, ITEM.split(" ", 2)[2] + " end"), (4, None), (5, ""), (6, ITEM), (6, ITEM), (7, "filler " * 60_000 + ITEM)]
    items = [(10, ITEM), (11, ITEM), (12, "short one"), (13, None), (14, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "doc_id AS item_id")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, leak.leaks(d, "doc_id", "text", i, "item_id", "text").collect()))
    assert sorted(set(got)) == brute(docs, items, 10) and (3, 10) in got and (2, 10) not in got and got.count((6, 10)) == 2
    assert leak.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0
    assert leak.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0


def test_packs_of_items_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(leak, "PACK_BYTES", 60 * leak.WORD_BYTES)
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.choices("abcdefg", k=14))) for i in range(20)]
    items += [(100 + i, t) for i, t in items[:5]]
    docs = [(d, " ".join(rnd.choices("abcdefg", k=10)) + " " + items[d][1]) for d in range(20)]
    got = leak.leaks(spark.createDataFrame(docs, "d bigint, text string"), "d", "text", spark.createDataFrame(items, "i bigint, text string"), "i", "text")
    assert sorted(map(tuple, got.collect())) == brute(docs, items, 10)
    args = (spark.createDataFrame(docs, "d bigint, text string"), "d", "text", spark.createDataFrame(items, "i bigint, text string"), "i", "text")
    some = sorted(map(tuple, leak.cleaned(*args).collect()))
    monkeypatch.setattr(leak, "PACK_BYTES", 1 << 30)
    assert some == sorted(map(tuple, leak.cleaned(*args).collect())) and len(some) == 20


@pytest.mark.parametrize("letters, n", [("abcdefghij", 30), ("ab", 400)])
def test_an_automaton_stays_below_its_budget(letters, n):
    rnd = random.Random(3)
    vocab = [f"{a}{i}" for a in letters for i in range(1 if n == 400 else 300)]
    items = [(i, " ".join(rnd.choices(vocab, k=n))) for i in range(6_000 // n * 5)]
    auto = leak.Automaton(items, 10)
    total = sum(len(leak.words(t)) for _, t in items)
    assert auto.size() <= leak.WORD_BYTES * total
    again = pickle.loads(pickle.dumps(auto))
    text = leak.words("x " + items[0][1] + " y " + items[7][1])
    assert again.scan(text) == auto.scan(text) and {0, 7} <= auto.scan(text)[0]


def test_cleaned(spark):
    docs = [(1, "a, b c! " + ITEM + ". The end of it all and more words that nobody ever tested."), (2, ITEM), (3, None), (4, "clean text")]
    i = spark.createDataFrame([(10, ITEM)], "item_id bigint, text string")
    got = {r.doc_id: r for r in leak.cleaned(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", i, "item_id", "text").collect()}
    assert got[1].text == "a, b c! . The end of it all and more words that nobody ever tested." and got[1].leaked_words == 12 and not got[1].dropped
    assert got[2].dropped and got[2].text is None and got[3].text is None and not got[3].dropped and got[4].text == "clean text"
