import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from filigrane.llm import mil


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(k, len(mil.MEASURES))) for k in (1, 3, 2, 5)]
    y = np.array([0.0, 1, 1, 0])
    x, sizes = np.concatenate(bags), np.array([1, 3, 2, 5])
    starts, bag = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(4), sizes)
    w = {"E": rng.normal(size=(len(mil.MEASURES), 4)) / 5, "e": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "o": rng.normal(size=4), "b": np.zeros(1)}

    def loss():
        p = mil._forward(w, x, starts, bag)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad = mil._gradient(w, mil._forward(w, x, starts, bag), x, starts, bag, y)
    for k, a in w.items():
        at = tuple(0 for _ in a.shape)
        old = a[at]
        a[at] = old + 1e-6
        up = loss()
        a[at] = old - 1e-6
        down = loss()
        a[at] = old
        assert abs((up - down) / 2e-6 - grad[k][at]) < 1e-6


def test_one_bad_passage_is_found():
    rng = np.random.default_rng(1)
    bags, y = [], []
    for i in range(300):
        b = rng.normal(size=(rng.integers(1, 20), len(mil.MEASURES)))
        if i % 2:
            b[rng.integers(len(b)), 3] += 6
        bags.append(b)
        y.append(i % 2)
    p = mil.predict(mil.train(bags, np.array(y)), bags)
    assert np.mean((p > 0.5) == np.array(y)) > 0.95


def plain_measures(words, text):
    """Measures of one passage, word by word: its words and the stretch of text that holds them."""
    n, chars, letters = len(words), sum(map(len, words)), "".join(words)
    mean, counts = chars / n, collections.Counter(words)
    symbols = [text.count(c) for c in mil._SYMBOLS]
    return [
        n / mil.PASSAGE, len(text) / (8 * mil.PASSAGE), mean / 8, (sum((len(w) - mean) ** 2 for w in words) / n) ** 0.5 / 8, min(max(map(len, words)), 100) / 50,
        sum(symbols) / chars, sum(c > 0 for c in symbols) / 8, text.count("|") / n, sum(text.count(c) for c in mil._POINTS) / n, sum(w[-1] in mil._SYMBOLS for w in words) / n,
        sum(c in "0123456789" for c in letters) / chars, sum(c.isupper() for c in letters) / chars, sum(ord(c) > 127 for c in letters) / chars, text.count("\n") / n, sum(w in mil._STOP for w in words) / n,
        len(counts) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, max(counts.values()) / n, sum(len(w) == 1 for w in words) / n, sum(w[0].isupper() for w in words) / n,
    ]


def plain_bag(text):
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
    parts = [found[k : k + mil.PASSAGE] for k in range(0, len(found), mil.PASSAGE)]
    return np.array([plain_measures([m[0] for m in p], text[p[0].start() : p[-1].end()]) for p in parts] or [[0.0] * len(mil.MEASURES)])


def random_text(rng, n):
    return "".join(rng.choice(["the ", "The", "und ", "a", " ", "\n", "\t", "é", "Ä", "9", "%", "| ", "#", ". ", "река", "\U0001f600", "word "]) for _ in range(n))


def test_measures_equal_a_plain_version(monkeypatch):
    rng = random.Random(6)
    texts = [random_text(rng, rng.choice([0, 1, 5, 90, 800])) for _ in range(120)] + [None, "", " \n ", "x" * 300]
    for stretch in (1 << 20, 700):
        monkeypatch.setattr(mil, "STRETCH_CHARS", stretch)
        got = [b for group in mil.bags(texts) for b in group]
        assert len(got) == len(texts)
        for t, b in zip(texts, got, strict=True):
            np.testing.assert_allclose(b, plain_bag(t), atol=2e-6)


def plain_score(model, bag):
    """The network's score of one document, passage by passage."""
    w, logistic = model.weights, lambda v: 1 / (1 + math.exp(-v))
    hidden, heat = [], []
    for row in bag:
        x = [min(max((v - m) / s, -8), 8) for v, m, s in zip(row, model.shift, model.scale, strict=True)]
        h = [math.tanh(sum(x[i] * float(w["E"][i][j]) for i in range(len(x))) + float(w["e"][j])) for j in range(mil.HIDDEN)]
        gate = [math.tanh(sum(h[i] * float(w["V"][i][j]) for i in range(len(h)))) * logistic(sum(h[i] * float(w["U"][i][j]) for i in range(len(h)))) for j in range(mil.ATTENTION)]
        hidden.append(h)
        heat.append(math.exp(sum(g * float(v) for g, v in zip(gate, w["w"], strict=True))))
    z = [sum(a * h[j] for a, h in zip(heat, hidden, strict=True)) / sum(heat) for j in range(mil.HIDDEN)]
    return logistic(sum(a * float(o) for a, o in zip(z, w["o"], strict=True)) + float(w["b"][0]))


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(9)
    texts = [random_text(rng, rng.choice([4, 60, 900])) for _ in range(60)]
    labels = [int(t.count("%") * 17 < len(t)) for t in texts]
    model = mil.train([plain_bag(t).astype(np.float32) for t in texts], np.array(labels))
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    got = {r.doc_id: r.p for r in docs.select("doc_id", mil.score_column(model, docs.text, spark).alias("p")).collect()}
    for i, t in enumerate([*texts, None, ""]):
        assert abs(got[i] - plain_score(model, plain_bag(t))) < 1e-4


def test_training_takes_whole_bags_and_documents_that_exist(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (6400 if i == 3 else 100)) for i in range(40)] + [(7, "word")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(mil, "train", lambda b, y: seen.append((b, y)) or mil.Model(np.zeros(20), np.ones(20), {}, 0.5))
    mil.fit(docs, labels)
    sizes = [len(b) for b in seen[0][0]]
    expected = [1 if i == 7 else 100 if i == 3 else 2 for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(sizes) == sorted(expected) or sorted(sizes) == sorted([2 if k == 1 else k for k in expected])
    monkeypatch.setattr(mil, "TRAIN_PASSAGES", 20)
    mil.fit(docs, labels)
    assert 18 <= sum(map(len, seen[1][0])) <= 20 and 100 not in map(len, seen[1][0])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the driver's tables are not here")
def test_held_out_rows_of_the_driver(spark):
    for sf in ("sf0.01", "sf0.1"):
        labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
        got = mil.scores(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
        assert np.mean([r.predicted == r.quality for r in got]) >= 0.96


def test_every_passage_is_encoded():
    text = " ".join(f"w{i}" for i in range(1000))
    assert len(mil.encode(text)) == 16
    assert mil.encode("").shape == mil.encode(None).shape == (1, len(mil.MEASURES))


def test_scores(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        words = [rng.choice(["the", "house", "of", "river", "and", "walked"]) + ("" if good else rng.choice(["%%%", "###", "|"])) for _ in range(rng.randint(5, 200))]
        rows.append((i, " ".join(words), 0.5))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(None, None, 0.5), (5, "", 0.5), (5, "", 0.5), (7000, "the river " * 20000, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = mil.scores(docs, lab).collect()
    assert len(got) == 604
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2)
    right = [r.predicted == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id != 5]
    assert np.mean(right) > 0.98
    assert {r.score for r in mil.scores(docs, lab.limit(0)).collect()} == {0.5}
    assert mil.scores(docs.limit(0), lab).count() == 0
