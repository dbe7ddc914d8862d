from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from orefold.llm import history

SCHEMA = "finding_id bigint, proposal_id string, message string, fingerprint string"
ARGS = ("finding_id", "proposal_id", "message", "fingerprint")


def brute(data, accepted=()):
    """One by one, against every accepted row."""
    kept, out = list(accepted), []
    for i, p, m, f in sorted(data):
        if p is None:
            continue
        me = (i, re.sub("[^a-z0-9]", "", p.lower()), None if m is None else frozenset(re.findall("[a-z0-9]+", m.lower())), None if f is None else f.lower().removeprefix("sha256:"))
        for j, k, t, h in kept:
            if k == me[1] and (h is not None and h == me[3] or t and me[2] and 4 * len(t & me[2]) >= 3 * len(t | me[2])):
                out.append((j, i))
                break
        else:
            kept.append(me)
    return sorted(out)


def sample(n, seed, *, keys=6, chains=True):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base, out = [], []
    for i in range(n):
        if base and rnd.random() < 0.6:
            p, m, f = rnd.choice(base)
            t = m.split()
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            m = " ".join(rnd.sample(t, len(t))).upper() if rnd.random() < 0.3 else " ".join(t)
            f = rnd.choice([f, f.upper(), f.replace("sha256:", ""), f"sha256:{rnd.getrandbits(64):016x}"])
            p = rnd.choice([p, p.lower(), p.replace("-", " "), f"{p} "])
        else:
            p = "HOT-1" if rnd.random() < 0.4 else f"P-{rnd.randrange(keys)}"
            m, f = " ".join(rnd.choices(words, k=12)), f"sha256:{rnd.getrandbits(64):016x}"
        if chains:
            base.append((p.strip().upper().replace(" ", "-"), m, "sha256:" + f.lower().removeprefix("sha256:")))
        elif len(base) < 40:
            base.append((p, m, f))
        r = rnd.random()
        out.append((i, None if r < 0.02 else p, None if 0.02 < r < 0.05 else m, None if 0.05 < r < 0.1 else f))
    return out


def found(df, **more):
    return sorted(map(tuple, history.repeats(df, *ARGS, **more).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_one_by_one_rule(spark, seed):
    data = sample(500, seed)
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "message AS form", "finding_id AS id", "1 AS n").repartition(5)
    assert found(df) == brute(data)


@pytest.mark.parametrize("part, block, pair", [(1, 16, 10_000), (7, 16, 3), (20_000, 20_000, 2), (20_000, 3, 0)])
def test_parts_blocks_and_pairs_give_the_same(spark, monkeypatch, part, block, pair):
    data = sample(160, 9, keys=2)
    df = spark.createDataFrame(data, SCHEMA)
    monkeypatch.setattr(history, "PART_ROWS", part)
    monkeypatch.setattr(history, "BLOCK_ROWS", block)
    monkeypatch.setattr(history, "PAIR_ROWS", pair)
    assert found(df) == brute(data)


def test_a_long_chain_takes_as_many_rounds_as_parts(spark, monkeypatch):
    """Each row agrees with its neighbours only, so every second decision hangs on the one before."""
    words = [f"w{i}" for i in range(420)]
    data = [(i, "HOT", " ".join(words[i : i + 12]), None) for i in range(400)]
    rounds, real = [], history._nearest
    monkeypatch.setattr(history, "_nearest", lambda posted: rounds.append(1) or real(posted))
    monkeypatch.setattr(history, "PART_ROWS", 100)
    assert found(spark.createDataFrame(data, SCHEMA)) == brute(data) and len(rounds) <= 6


def test_hot_tokens_meet_in_pairs_only(spark):
    """One token in every message of a proposal: under pairs of tokens few rows stand together."""
    rnd = random.Random(8)
    data = [(i, "HOT", f"hot a{rnd.randrange(40)} b{rnd.randrange(40)} c{rnd.randrange(40)}", None) for i in range(600)]
    rows = history.normalised(spark.createDataFrame(data, SCHEMA), *ARGS)
    weights = bytearray(b"\xff" * history.BUCKETS)
    weights[spark.sql(f"SELECT pmod(xxhash64('hot'), {history.BUCKETS})").first()[0]] = 0
    posted = history.postings(rows, bytes(weights)).join(rows, "id")
    pairs = history.paired(posted, bytes(weights)).groupBy("h").count()
    assert posted.groupBy("h").count().agg(F.max("count")).first()[0] == 600 and pairs.agg(F.max("count")).first()[0] < 60
    assert found(spark.createDataFrame(data, SCHEMA), weights=bytes(weights)) == brute(data)


def test_prefix_tokens_of_similar_sets_always_meet(spark):
    rnd = random.Random(5)
    data = []
    for i in range(0, 400, 2):
        t = [f"t{rnd.randrange(300)}" for _ in range(rnd.randrange(1, 20))]
        u = t[:]
        if rnd.random() < 0.7:
            u[rnd.randrange(len(u))] = "z"
        data += [(i, "p", " ".join(t), None), (i + 1, "p", " ".join(u), None)]
    assert found(spark.createDataFrame(data, SCHEMA)) == brute(data)


def test_batches_against_an_index(spark, tmp_path):
    data = sample(240, 4)
    index = history.Index(spark, str(tmp_path / "index"), compact_every=2)
    got = []
    for a in range(0, 240, 60):
        got += [tuple(r) for r in index.add(spark.createDataFrame(data[a : a + 60], SCHEMA), *ARGS).collect()]
    assert sorted(got) == brute(data) and len(index.shards) == 2


def test_a_batch_meets_only_the_history_it_asks_for(spark, tmp_path, monkeypatch):
    """No key of the history goes through the comparison unless a row of the new batch asks under it."""
    data = sample(240, 4)
    seen, real = [], history.decide

    def spy(posted):
        seen.append([(r.h, r.asked) for r in posted.groupBy("h").agg(F.max("asks").alias("asked")).collect()])
        return real(posted)

    monkeypatch.setattr(history, "decide", spy)
    index = history.Index(spark, str(tmp_path / "index"))
    got = []
    for part in (data[:230], data[230:]):
        got += [tuple(r) for r in index.add(spark.createDataFrame(part, SCHEMA), *ARGS).collect()]
    assert sorted(got) == brute(data)
    assert seen[1] and all(asked for _, asked in seen[1]) and len(seen[1]) < len(seen[0])


def test_hot_keys_are_counted_among_what_stands_under_the_keys(spark, tmp_path, monkeypatch):
    """A small batch against a history a thousand times its size broadcasts no more than HOT_SHARE keys."""
    from orefold.plans import skew

    totals, real = [], history.dictionary_join
    monkeypatch.setattr(history, "dictionary_join", lambda rows, entries, keys, **o: totals.append((entries.where(F.col("n") * skew.HOT_SHARE >= o["total"]).count(), keys)) or real(rows, entries, keys, **o))
    old = [(i, f"P-{i % 500}", f"m{i} x{i % 97} y{i % 89}", None) for i in range(3_000)]
    index = history.Index(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(old, SCHEMA), *ARGS)
    new = [(3_000 + i, f"P-{i}", f"m{i} x{i % 97} y{i % 89}", None) for i in range(3)]
    assert sorted(map(tuple, index.add(spark.createDataFrame(new, SCHEMA), *ARGS).collect())) == [(i, 3_000 + i) for i in range(3)]
    assert totals and all(n <= skew.HOT_SHARE for n, _ in totals)


def test_by_arrival_equals_one_pass(spark):
    data = sample(200, 6) + [(None, "HOT-1", "no id", None)]
    df = spark.createDataFrame(data, SCHEMA)
    got = history.repeats_by_arrival(df, *ARGS, parts=4, compact_every=3)
    assert sorted(map(tuple, got.collect())) == brute([d for d in data if d[0] is not None])
    assert history.repeats_by_arrival(df.limit(0), *ARGS, parts=4, compact_every=3).count() == 0


def test_hot_exact_copies(spark):
    data = [(i, "HOT", "same old message here", "sha256:AA") for i in range(800)] + [(800 + i, "HOT", f"other {i} thing {i * 7} x{i}", None) for i in range(50)]
    assert found(spark.createDataFrame(data, SCHEMA)) == brute(data) == [(0, i) for i in range(1, 800)]


def test_one_fingerprint_over_many_messages_beside_null_ones(spark):
    """The hot key spans several Arrow batches, the first of which holds null fingerprints too."""
    nulls = [(i, f"N-{i // 2}", f"lone{i // 2} words here{' too' * (i % 2)}", None) for i in range(400)]
    data = nulls + [(400, "HOT", "w0", None)] + [(401 + i, "HOT", f"m{i} x{i * 7} y{i * 11}", "sha256:AB") for i in range(5_000)]
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    assert found(df) == brute(data)


def test_nulls_empty_and_ties(spark):
    data = [(1, "a", None, None), (2, "a", "", None), (3, "a", "!!", ""), (4, "a", "?", ""), (5, None, "x y", "f"), (6, "b", "x y", "f"), (7, "B.", "q", "F"), (8, "", "x y z w", None), (9, "-", "x y z w", None)]
    assert found(spark.createDataFrame(data, SCHEMA)) == brute(data) == [(3, 4), (6, 7), (8, 9)]
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_a_rejected_row_blocks_nothing(spark):
    a, b, c = "a b c d e f g h i j k l", "a b c d e f g h i j k x", "a b c d e f g h i y k x"
    data = [(1, "p", a, None), (2, "p", b, None), (3, "p", "m n o", "f"), (4, "p", c, None), (5, "p", "u v w", "f"), (6, "p", "u v w", None)]
    assert brute(data) == found(spark.createDataFrame(data, SCHEMA))
    assert (5, 6) not in brute(data)


def test_long_message(spark):
    m = " ".join(f"w{i}" for i in range(3_000))
    assert found(spark.createDataFrame([(1, "p", m, None), (2, "p", m + " more", None)], SCHEMA)) == [(1, 2)]
