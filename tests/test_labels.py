import random

from pyspark.sql import functions as F

from filigrane.functions.taxonomy import FINANCE
from filigrane.operators import labels

L = FINANCE.labels


def plain(p, t=0.35):
    """The priority rules, step by step."""
    g = lambda k: p.get(k, 0.0)
    found = []
    uses = {k: g(f"{k}_use") >= t for k in FINANCE.types}
    times = [x for x in ("curr", "hist", "spec") if g(x) >= t]

    def best(score):
        top = max(map(score, FINANCE.specific))
        return next(s for s in FINANCE.specific if score(s) == top) if top >= 0.7 * t and top > 0 else "gen"

    for k in FINANCE.types:
        if g(k) < t and not uses[k]:
            continue
        ids = FINANCE.usage_ids[best(lambda s: g(s) + g(f"{s}_use")) if k == "gen" else k]
        if uses[k]:
            if times:
                found += [(1 + ["curr", "hist", "spec"].index(x), g(f"{k}_use") * g(x), ids[["curr", "hist", "spec"].index(x)]) for x in times]
            else:
                found.append((1.5, g(f"{k}_use"), ids[0]))
        elif not any(uses.values()) and "spec" not in times:
            found += [(5, g(k) * g(x), ids[["curr", "hist"].index(x)]) for x in times]
    for x, (now, then) in FINANCE.extra_ids.items():
        if g(x) >= t:
            found.append((4, g(x) * g("curr"), now) if "curr" in times else (7, g(x), then))
    if not any(uses.values()):
        for k in FINANCE.types:
            if g(k) >= t:
                r = best(g) if k == "gen" else k
                found.append((8.1 if r == "eq" else 8, g(k), FINANCE.context_ids[r]))
    if g("irr") >= t:
        found.append((9, g("irr"), 24))
    out = []
    for _, s, i in sorted(found, key=lambda x: (x[0], -x[1])):
        if i not in [o[0] for o in out]:
            out.append((i, s))
    return out or [(24, 0.0)]


def frame(spark, rows):
    schema = "i int, " + ", ".join(f"{k} double" for k in L)
    return spark.createDataFrame([(i, *[r.get(k) for k in L]) for i, r in enumerate(rows)], schema)


def test_resolution_equals_the_rules(spark):
    rng = random.Random(1)
    rows = [{k: rng.choice([0.0, 0.2, 0.245, 0.35, 0.5, 0.9]) if rng.random() < 0.45 else 0.0 for k in L} for _ in range(400)]
    rows += [{}, {"ir_use": 0.35}, {"gen": 0.5, "fx": 0.25}, {"gen": 0.4, "eq": 0.3}, {"warr": 0.4, "curr": 0.35}, {"ir": 0.5, "curr": 0.5, "spec": 0.5}]
    got = {r.i: list(zip(r.label_ids, [round(s, 9) for s in r.label_scores], strict=True)) for r in labels.resolve(frame(spark, rows)).collect()}
    assert got == {i: [(a, round(b, 9)) for a, b in plain(r)] for i, r in enumerate(rows)}


def test_counts_use_the_threshold_and_skip_errors(spark):
    rows = [("a", '[{"ir": 0.45}, {"error": -1}, {"ir": 0.4499, "curr": 0.9}]'), ("b", "not json"), ("c", "[]"), ("d", None)]
    d = labels.from_maps(spark.createDataFrame(rows, "url string, server_response string"), "server_response")
    got = labels.label_counts(d, ["url"]).collect()
    assert [(r.url, r.n_sentences, r.n_ir, r.n_curr) for r in got] == [("a", 2, 1, 1)]
    assert sorted(r.n for r in d.collect()) == [1, 3]


def test_small_functions(spark):
    one = spark.range(1)
    assert one.select(labels.tier(F.lit(0.75)), labels.tier(F.lit(0.5)), labels.tier(F.lit(0.49))).first()[:] == ("high", "medium", "low")
    assert one.select(labels.sigmoid(F.lit(1e9), 8), labels.argmax_label(F.array().cast("array<double>")), labels.name_of(F.lit(99))).first()[:] == (1.0, -1, "Unknown")
    assert one.select(labels.category_of(F.lit("FX Derivative (Current)"))).first()[0] == "FX_Derivative"


def test_hot_and_bargaining(spark):
    d = frame(spark, [{"warr": 1.0, "hist": 1.0}, {"emb": 1.0, "ir_use": 1.0}, {"fx_use": 1.0, "hist": 1.0}, {"fx_use": 1.0}, {"cp": 1.0, "spec": 1.0}, {"eq": 1.0}, {}])
    assert [r[0] for r in d.orderBy("i").select(labels.multi_hot_primary()).collect()] == [21, 22, 7, 6, 11, 19, 24]
    b = spark.createDataFrame([(1, 0, 0, 1, 0), (1, 0, 0, 1, 1), (0, 1, 0, 0, 0), (0, 0, 1, 0, 0), (0, 0, 0, 0, 0)], "cb_coverage int, cb_risk int, no_cb int, cb_us int, cb_international int")
    assert [r[0] for r in b.select(labels.bargaining_primary()).collect()] == [5, 0, 2, 3, 6]
