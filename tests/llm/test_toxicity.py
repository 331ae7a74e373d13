import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from filigrane.llm import toxicity


def brute_segments(scores):
    """All maximal segments by their recursive definition: the best segment, then the same on both sides."""
    out = []

    def go(a, b):
        best = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += scores[j]
                if s > 0 and (best is None or s > best[0] + 1e-12 or (abs(s - best[0]) <= 1e-12 and j - i < best[2] - best[1])):
                    best = (s, i, j)
        if best:
            out.append((best[1], best[2], round(best[0], 6)))
            go(a, best[1])
            go(best[2] + 1, b)

    go(0, len(scores))
    return sorted(out)


def test_segments_equal_their_definition():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(0, 25)
        hits = [(i, rng.choice([0.93, 1.71, 2.57, 5.13])) for i in range(n) if rng.random() < 0.35]
        scores = [-0.71] * n
        for i, s in hits:
            scores[i] = s
        got = sorted((a, b, round(s, 6)) for a, b, s in toxicity.segments(hits, -0.71))
        assert got == brute_segments(scores)


def test_evidence():
    assert toxicity.evidence([], 1, 0.01) < 0
    assert toxicity.evidence([8.0], 50, 0.01) < toxicity.evidence([8.0, 8.0], 50, 0.01)
    assert toxicity.evidence([8.0], 50, 0.01) > toxicity.evidence([8.0], 5000, 0.01)
    many = [9.0] * 30
    assert toxicity.evidence(many, 20000, 0.01) > toxicity.evidence(many[:8], 20000, 0.01)


def test_words_and_weights_by_either_way():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abCD09_ .,-\n\x1f\x0bé²ßİ"[: rng.choice((12, 18))]) for _ in range(rng.randint(0, 200)))
        found = toxicity.words(text)
        assert found == re.findall(r"[^\W_]+", text.lower())
        counts = collections.Counter(found)
        every = toxicity.weights(counts)
        some = {t for t in every if rng.random() < 0.4} | {"other", "^othe"}
        assert toxicity.weights(counts, toxicity.Terms(some)) == {t: w for t, w in every.items() if t in some}


def test_the_bar_is_that_of_benjamini_and_hochberg():
    rng = random.Random(4)
    for _ in range(50):
        found = [rng.uniform(0, 14) for _ in range(rng.randint(1, 30))]
        tested = rng.randint(len(found), 500)
        p = sorted(math.exp(-g) for g in found)
        passing = [i for i, x in enumerate(p, 1) if x <= toxicity.FALSE_RATE * i / tested]
        bar = toxicity.least_significance(np.array(found), tested)
        assert sum(g >= bar for g in found) == (max(passing) if passing else 0)


def brute_model(rows):
    """(text, label, fold) of labelled documents, and the corpus → terms and scores by their definition, and for each fold those learned without it."""

    def weigh(text):
        ws = re.findall(r"[^\W_]+", text.lower())
        every = [t for w in ws for t in [w, *["^" + w[:k] for k in (4, 5, 6, 7) if len(w) > k]]]
        return {t: 1 + math.log(every.count(t)) for t in set(every)}, sum(1 + math.log(ws.count(w)) for w in set(ws))

    labelled, corpus = rows
    seen = [(y, k, *weigh(t)) for t, y, k in labelled]
    everywhere = [weigh(t) for t in corpus]
    whole = sum(n for _, n in everywhere)
    vocabulary = {t for y, _, ws, _ in seen if y for t in ws}
    heavy = {t for t in vocabulary if sum(t in ws for y, _, ws, _ in seen if y) >= toxicity.MIN_DOCS}

    def strength(without):
        sums = {y: (collections.Counter(), 0.0) for y in (0, 1)}
        for y, k, ws, n in seen:
            if k != without:
                for t in heavy & set(ws):
                    sums[y][0][t] += ws[t]
                sums[y] = (sums[y][0], sums[y][1] + n)
        (c, nc), (x, nx) = sums[0], sums[1]
        share, out = nx / (nx + nc), {}
        for t in heavy:
            n = x[t] + c[t]
            p = x[t] / n if n else 0
            out[t] = 0.0 if p <= share else n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0))
        return out, x, c, nx, nc

    ranked = sorted(strength(None)[0].values(), reverse=True)
    passing = [g for i, g in enumerate(ranked, 1) if math.exp(-g) <= toxicity.FALSE_RATE * i / len(vocabulary)]
    models = []
    for k in (None, *range(toxicity.FOLDS)):
        strong, x, c, nx, nc = strength(k)
        a, model = toxicity.PRIOR_SHARE * (nx + nc), {}
        for t in heavy:
            if strong[t] >= passing[-1]:
                prior = a * sum(ws.get(t, 0) for ws, _ in everywhere) / whole
                score = math.log((x[t] + prior) / (nx + a - x[t] - prior)) - math.log((c[t] + prior) / (nc + a - c[t] - prior))
                if score > 0:
                    model[t] = (score, strong[t])
        models.append(model)
    return models


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(31)
    texts, labels = [], []
    for i in range(260):
        ws = [rng.choice(["the", "of", "river", "houses", "walked", "window"]) for _ in range(rng.randint(3, 40))]
        for _ in range(2 * (i % 5 == 0)):
            ws.insert(rng.randrange(len(ws)), rng.choice(["morons", "moronic", "scum"]))
        texts.append(" ".join(ws))
        labels.append(int(i % 5 == 0) if i % 17 else 1 - int(i % 5 == 0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.scores(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")).collect()}
    fold = {r.doc_id: r.k for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(toxicity.FOLDS)).alias("k")).collect()}
    train = [i for i in range(260) if zlib.crc32(str(i).encode()) % 3 != 1]
    models = brute_model(([(texts[i], labels[i], fold[i]) for i in train], texts))
    assert any(t.startswith("^moro") for t in models[0]) and "scum" in models[0]

    def known(text, model):
        ws, out = text.split(), []
        for w in ws:
            own = [t for t in [w, *["^" + w[:k] for k in (7, 6, 5, 4) if len(w) > k]] if t in model]
            out.append(model[max(own, key=lambda t: model[t][1])][0] if own else None)
        return out

    def best(text, model, gap):
        return sorted((s for _, _, s in brute_segments([gap if s is None else s for s in known(text, model)])), reverse=True)

    clip = lambda e: min(max(e, toxicity.LOW), toxicity.HIGH)
    tried = []
    for bar in toxicity.BARS:
        own = [{t: x for t, x in m.items() if x[0] >= bar} for m in models]
        found = {i: known(texts[i], own[1 + fold[i]]) for i in train}
        rate = lambda ids: sum(s is not None for i in ids for s in found[i]) / sum(len(found[i]) for i in ids)  # noqa: E731, B023
        gap = math.log(1 - rate([i for i in train if labels[i] and any(found[i])])) - math.log(1 - rate([i for i in train if not labels[i]]))  # noqa: B023
        apart = {i: best(texts[i], own[1 + fold[i]], gap) for i in train}
        constant = 1 / np.mean([len(found[i]) * math.exp(-(apart[i] or [0.0])[0]) for i in train if not labels[i]])
        x = {i: round(clip(toxicity.evidence(apart[i], len(found[i]), constant)) / toxicity.BIN) * toxicity.BIN for i in train}
        slope, offset = toxicity._curve([(x[i], labels[i], 1) for i in train])
        loss = sum(math.log1p(math.exp(slope * x[i] + offset)) - labels[i] * (slope * x[i] + offset) for i in train)
        tried.append((round(loss, 6), bar, own[0], gap, constant, slope, offset))
    _, _, model, gap, constant, slope, offset = min(tried, key=lambda t: t[:2])
    for i, t in enumerate(texts):
        e = clip(toxicity.evidence(best(t, model, gap), len(t.split()), constant))
        assert abs(got[i].score - 1 / (1 + math.exp(-(slope * e + offset)))) < 1e-3, i


def test_the_curve_is_the_likeliest():
    """Also where plain Newton steps would swing to and fro."""
    rng = random.Random(3)
    for _ in range(40):
        wide = rng.choice([1, 10, 60])
        bins = [(rng.uniform(-wide / 3, wide), int(rng.random() < 0.3), rng.randint(1, 500)) for _ in range(rng.randint(2, 40))]
        slope, offset = toxicity._curve(bins)
        if slope > 1e-3:
            cost = lambda a, b: toxicity._loss(bins, a, b) + 5e-3 * (a * a + b * b)  # noqa: E731, B023
            assert all(cost(slope, offset) <= cost(slope + da, offset + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the driver's tables are not here")
def test_held_out_rows_of_the_driver(spark):
    """Label noise bounds the recall: about one toxic document in twenty has no toxic word. The 33 toxic documents that sf0.01 trains on rank well, but leave the curve cautious."""
    for sf, area, recall, alarms in (("sf0.01", 0.95, 0.75, 0.0), ("sf0.1", 0.96, 0.9, 0.002), ("check_s", 0.999, 0.99, 0.001)):
        if not os.path.isdir(f"/root/testdata/{sf}"):
            continue
        labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
        got = toxicity.scores(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
        assert np.mean([r.predicted for r in got if r.toxic]) >= recall
        assert np.mean([r.predicted for r in got if r.toxic == 0]) <= alarms
        ranks = pd.Series([r.score for r in got]).rank().to_numpy()
        toxic = np.array([r.toxic for r in got])
        ones, zeros = toxic.sum(), len(toxic) - toxic.sum()
        assert (ranks[toxic == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros) >= area


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 7 == 0
        words = [rng.choice(["the", "of", "and", "house", "river", "walked", "ähnlich"]) for _ in range(rng.randint(5, 60))]
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["moron", "scumbag", "scumbags"]))
        rows.append((i, " ".join(words), "en", 0.5))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(None, None, None, None), (5, "", "x", 1.0), (5, "", "x", 1.0), (9001, "moron " * 30000, "en", 0.1)]
    labels += [(None, 1, 1), (4, None, None), (0, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_find_toxic_rows(made):
    docs, labels = made
    rows = toxicity.scores(docs, labels).collect()
    assert len(rows) == 904
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1)
    right = [r.predicted == (r.doc_id % 7 == 0) for r in rows if r.doc_id is not None and r.doc_id < 900 and r.doc_id != 5]
    assert np.mean(right) > 0.99


def test_reject_and_degenerate(made, spark):
    docs, labels = made
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 9001 not in ids and None in ids and ids.count(5) == 3
    few = spark.createDataFrame([(1, "a text"), (None, None)], "doc_id long, text string")
    none = labels.limit(0)
    assert [r.predicted for r in toxicity.scores(few, none).collect()] == [0, 0]
    assert toxicity.scores(few.limit(0), none).count() == 0
