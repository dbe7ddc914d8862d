from __future__ import annotations

import random

import numpy as np

from orefold.llm import level

EASY = ["The red salt is wet.", "We put the clay in the big pot.", "It did not burn.", "Is the dust old?", "I saw 12 gray spots on it.", "They heated the ash and went home."]
HARD = [
    "Notwithstanding the ostensibly favourable enthalpy attributed to the perovskite, comprehensive screening demonstrates that decomposition products remain inaccessible irrespective of the prevailing oxygen potential.",
    "Systematic discrepancies between claimed and normalised quantities, e.g. 3.91 versus 51.9, indicate that the generator substitutes conductivity inconsistently across batches.",
    "The absence of evidence must not be interpreted as novelty, because reference comparison was unavailable for approximately 5.2 percent of candidates.",
]
GERMAN = "Das Pulver wurde bei 900 Grad im Ofen geglüht und danach lange gemahlen, aber die Probe ist nicht rein und der Wert für die Dichte ist zu hoch. " * 2
# Languages no graded document is written in.
FOREIGN = [
    "Sampel tersebut dipanaskan selama dua jam pada suhu tinggi dan kemudian didinginkan secara perlahan di dalam tungku. Hasil pengukuran menunjukkan bahwa struktur kristal tetap stabil dan tidak ada perubahan warna yang terlihat setelah proses ini",
    "Provet värmdes i ugnen under två timmar och fick sedan svalna långsamt till rumstemperatur. Mätningarna visar att strukturen förblir stabil och att ingen förändring av färgen kunde ses efter behandlingen som forskarna utförde i laboratoriet",
    "Numune iki saat boyunca yüksek sıcaklıkta ısıtıldı ve daha sonra fırının içinde yavaşça soğumaya bırakıldı. Ölçüm sonuçları kristal yapının kararlı kaldığını ve işlemden sonra görünür bir renk değişimi olmadığını açıkça ve kesin olarak göstermektedir diyor",
    "Probka byla ogrzewana przez dwie godziny w wysokiej temperaturze, a potem powoli chlodzona w piecu. Wyniki pomiarow wskazuja, ze struktura krystaliczna pozostaje stabilna i nie widac zadnych zmian koloru po zakonczeniu procesu przez badaczy",
]
LOG = "\n".join(f"[{i:02d}:00] WARN code=GEO.SCALE ptr=/structure/sites/{i} n={i}" for i in range(30))


def text(rnd, pool, n, sep=" "):
    return sep.join(rnd.choices(pool, k=n))


def features(x):
    reader = level.Reader(bytes(level.BUCKETS))
    return np.median(reader.features([x])[1], axis=0)


def test_layout_and_case_do_not_count():
    rnd = random.Random(1)
    s = rnd.choices(HARD, k=6)
    forms = [" ".join(s), "\n".join(s), "\n\n".join(s), "\n".join(f"- {x}" for x in s), "\r\n".join(f"{i}) {x}" for i, x in enumerate(s, 1)), " ".join(s).upper(), " ".join(s).lower(), " ".join(s).replace(" the ", "\nthe ")]
    f = [features(x) for x in forms]
    assert all(np.allclose(f[0], x, atol=0.12) for x in f[1:])


def test_features_of_many_texts_are_those_of_each():
    rnd = random.Random(4)
    texts = [text(rnd, HARD + EASY, rnd.randrange(1, 9)) for _ in range(30)] + ["", "One.", "no words 1 2 3"]
    owner, x = level.Reader(bytes(level.BUCKETS)).features(texts)
    for i, t in enumerate(texts):
        alone = level.Reader(bytes(level.BUCKETS)).features([t])[1]
        assert np.allclose(x[owner == i], alone)
    m = level.medians(owner, x[:, 0], len(texts))
    assert all(np.isnan(m[i]) if not (owner == i).any() else m[i] == np.median(x[owner == i, 0]) for i in range(len(texts)))


def test_a_worker_forgets_words_without_changing_results(monkeypatch):
    texts = [" ".join(HARD), " ".join(EASY)]
    want = level.Reader(bytes(level.BUCKETS)).features(texts)[1]
    monkeypatch.setattr(level, "MEMORY_WORDS", 5)
    reader = level.Reader(bytes(level.BUCKETS))
    for _ in range(3):
        assert np.allclose(reader.features(texts)[1], want)


def trained_gate():
    rnd = random.Random(2)
    reader = level.Reader(bytes(level.BUCKETS))
    texts = [text(rnd, HARD + EASY, 12) for _ in range(200)]
    return level.gate(sum(np.bincount(level.triples(t), minlength=level.LETTERS**3) for t in texts), [reader.share(t)[0] for t in texts])


def test_what_has_no_level():
    g, reader = trained_gate(), level.Reader(bytes(level.BUCKETS))
    no = [None, "", " ", "Too short to count.", GERMAN, LOG, '{"a": 1}' * 40, "漢字 " * 50, *FOREIGN]
    assert reader.judged(no, g) == []
    rnd = random.Random(5)
    assert reader.judged([text(rnd, EASY, 12), HARD[0] * 3, HARD[2].upper() * 2], g) == [0, 1, 2]


def test_isotonic_is_monotone():
    x, y = level.isotonic(np.array([1, 2, 3, 4.0]), np.array([1, 3, 2, 4.0]))
    assert list(y) == [1, 2.5, 4] and list(x) == [1, 2.5, 4]


def test_few_errors_make_no_step_of_their_own():
    x = np.arange(200.0)
    y = np.r_[np.full(99, 3.0), 4, 3, np.full(99, 4.0)]
    assert len(level.isotonic(x, y)[0]) == 3
    knots, steps = level.isotonic(x, y, least=0.02)
    assert len(knots) == 2 and abs(np.interp(99.5, knots, steps) - 3.5) < 0.02


def corpus(seed):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(60):
        hard = i % 2
        t = text(rnd, HARD if hard else EASY, 5 if hard else 14, rnd.choice([" ", "\n"]))
        docs.append((i, t + (" 0x1f3a ​" if rnd.random() < 0.5 else "")))
        if i < 40:
            labels += [(i, (4 if hard else 1) + rnd.choice([0, 0, 1])) for _ in range(rnd.choice([1, 3]))]
    docs += [(100, None), (101, ""), (102, GERMAN), (103, LOG), (104, "Short."), (105, (text(rnd, HARD, 400)))]
    return docs, labels + [(0, None), (None, 3), (999, 5)]


def test_held_out_accuracy(spark):
    docs, labels = corpus(3)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "doc_id AS level")
    l = spark.createDataFrame(labels, "doc_id bigint, reading_level int")
    ranker = level.train(d, "doc_id", "text", l, "doc_id", "reading_level")
    got = {r.doc_id: r.level for r in level.levels(d, "doc_id", "text", ranker).collect()}
    assert len(got) == len(docs) and all((got[i] >= level.HARD) == bool(i % 2) for i in range(40, 60))
    assert all(got[i] is None for i in range(100, 105)) and got[105] >= level.HARD
    again = level.train(d.repartition(7), "doc_id", "text", l.repartition(3), "doc_id", "reading_level")
    assert np.allclose(again.ranker.weights, ranker.ranker.weights) and again.weights == ranker.weights


def test_without_labels_there_are_no_levels(spark):
    d = spark.createDataFrame([(1, "The red salt is wet. " * 10)], "doc_id bigint, text string")
    l = spark.createDataFrame([], "doc_id bigint, reading_level int")
    assert level.train(d, "doc_id", "text", l, "doc_id", "reading_level") is None
    assert [r.level for r in level.levels(d, "doc_id", "text", None).collect()] == [None]
    assert level.levels(d.limit(0), "doc_id", "text", None).count() == 0
