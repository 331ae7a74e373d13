import hashlib
import random
import re

from filigrane.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    wins = []
    for item, t in items:
        w = words(t)
        if w:
            wins += [(str(item), tuple(w[i : i + 10])) for i in range(max(1, len(w) - 9))]
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in wins:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit.update(range(s, s + len(x)))
                    found.add(item)
        out.append((-1 if i is None else i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def made():
    rng = random.Random(6)
    draw = lambda n: " ".join(rng.choice(["a", "B", "the", "É", "x1", "q-r", "z"]) for _ in range(n))
    items = [(i, draw(rng.randint(0, 25))) for i in range(25)] + [(3, "only three words"), (100, None), (20, "x"), (21, "")]
    docs = []
    for i in range(60):
        docs.append((i, draw(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "") + " " + draw(5)))
    return docs + [(7, docs[7][1]), (7, docs[8][1]), (None, docs[9][1]), (None, None), (90, ""), (91, "w " * 20000)], items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = made()
    d = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n_words int, h string")
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, win string")
    want = brute(docs, items)
    get = lambda: sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in decontam.digests(d, b).collect())
    assert get() == want
    monkeypatch.setattr(decontam, "BLOCK_ROWS", 60)  # several blocks of windows
    assert get() == want


def test_clean_and_empty(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    d = spark.createDataFrame([(1, "lead " + passage, "en", 1), (2, "other text", "en", 1), (None, None, None, None)], "doc_id long, text string, _id string, _h int")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2]
    assert decontam.digests(d, b.limit(0)).where("contaminated").count() == 0
    assert decontam.digests(d, b.limit(0)).count() == 3
    assert decontam.digests(d.limit(0), b).count() == 0
