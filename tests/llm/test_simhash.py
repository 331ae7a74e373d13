import random

import pytest
import xxhash

from filigrane.llm import simhash


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=3):
    root = dict.fromkeys(fps)
    for f in fps:
        root[f] = f

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["Ab", "É", "the", "x\x85y", "\t", "\n\x0b"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += ["", None, "one", "one two", "One\ttwo\x0cthree", "w " * 40000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.id: r.fp % (1 << 64) for r in simhash.fingerprints(df).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("hot", [1, 50_000])
def test_link_classes_equal_all_pairs(spark, monkeypatch, hot):
    """hot: members over which a cell is salted."""
    monkeypatch.setattr(simhash, "HOT_CELL", hot)
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(40):
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 7, 15, (1 << 64) - 1}
    hub = rng.getrandbits(64)  # many near copies of one text: a hot cell
    fps |= {hub ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute_components(sorted(f % (1 << 64) for f in signed))
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for rounds, blocks in ((0, 6), (2, None), (1, 8), (1, 12))[: 4 if hot > 1 else 2]:
        got = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.link_classes(df, pivot_rounds=rounds, blocks=blocks).collect()}
        groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
        assert {g for g in groups(want) if len(g) > 1} == groups(got)


def test_components_and_deduplicate(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(7, base, "en"), (3, base, "en"), (3, base, "en"), (9, base + " tail", "de"), (5, "quite another text of its own", None), (4, "", "en"), (6, None, "en"), (None, base, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    bits = (simhash.fingerprint(base) ^ simhash.fingerprint(base + " tail")).bit_count()
    assert got == [(-1, 3), (3, 3), (3, 3), (4, 4), (5, 5), (6, 4), (7, 3), (9, 3 if bits <= 3 else 9)]
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 4, 5] + ([] if bits <= 3 else [9])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 10**5, 2 * 10**7, 10**8, 10**11)] == [6, 6, 8, 8, 16]
    assert all(simhash.blocks_for(10**6, bits) > bits for bits in (0, 3, 20))


def test_repeated_ids_with_different_texts_all_stay(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(50))
    rows = [(5, words(1), 1.0), (5, words(2), 2.0), (6, words(3), 3.0), (7, words(2), 4.0), (5, words(1), 1.0), (5, words(1), 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _keep double")
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    assert got == sorted([(5, words(1)), (5, words(2)), (6, words(3))])
