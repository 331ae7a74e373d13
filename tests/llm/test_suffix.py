import hashlib
import random

import numpy as np
import pytest

from filigrane.llm import suffix


def brute(rows):
    """rows (id, text) in table order → sorted results by the definition."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), []
    for k in order:
        t = (rows[k][1] or "").encode()
        gone = bytearray(len(t))
        for s in range(len(t) - 99):
            w = t[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((-1 if rows[k][0] is None else rows[k][0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(12, 60)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            s = rng.randint(0, 20)
            parts += [p[s : len(p) - rng.randint(0, 20)], text(rng.randint(0, 6))]
        rows.append((rng.randint(0, 10_000), "".join(parts)))
    rows += [(5, passages[0]), (5, passages[0]), (4, passages[0]), (None, passages[1]), (None, None), (7, ""), (1, "x" * 99), (2, "x" * 100), (3, "x" * 700), (6, "ab" * 300), (8, "abc" * 90 + "d" + "abc" * 90)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [10**9, 1])
def test_equals_definition(spark, monkeypatch, hot):
    """hot: different contexts in the sample that make a gram hot, here none or all."""
    rows = made()
    monkeypatch.setattr(suffix, "SAMPLE_CONTEXTS", hot)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, row int, data string").coalesce(1)
    got = sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in suffix.digests(df).collect())
    assert got == brute(rows)


def test_settling_in_one_process(monkeypatch):
    """The same steps without workers, so that the small sizes above are surely in force."""
    import pyarrow as pa

    rows = made()
    want = brute(rows)
    for hot, size, spread in ((10**9, 3_000, False), (1, 3_000, False), (10**9, 10**7, False), (10**9, 3_000, True), (1, 3_000, True), (1, 10**7, True)):
        monkeypatch.setattr(suffix, "BATCH_BYTES", size)
        monkeypatch.setattr(suffix, "HOT_CONTEXTS", hot)
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["id", "row", "text"])
        table = lambda bs: pa.Table.from_batches(list(bs), pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())]))
        monkeypatch.setattr(suffix, "STRETCH_BYTES", max(150, size // 9))
        grams = suffix.anchors(*suffix._laid_out([(r[1] or "").encode() for r in rows]))["gram"]
        first = table(suffix._find_anchors(1, 1, np.sort(grams[:: 1 if size == 10**7 else 2]) if spread else grams[:0])([batch]))
        settled = suffix._settle_contexts(1)(first)
        packed = table(suffix._pack_documents(1)([batch]))
        contexts = suffix._fetch_contexts(1, 1)(packed, settled)
        ranges = suffix._settle_windows(1)(contexts)
        out = suffix._finish(packed, ranges).to_pylist()
        assert sorted((-1 if r["id"] is None else r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == want


def test_deep_shallow_sort():
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab\0") for _ in range(rng.randint(0, 20))) for _ in range(8)]
    strings = [("".join(rng.choice(pool) for _ in range(4)) + "z" * rng.randint(0, 20))[:90].encode() for _ in range(300)]
    strings += [b"q" * k for k in range(80)] + [b"", b""]
    group = np.array([rng.randrange(3) for _ in strings])
    text, size = np.zeros((len(strings), 100), np.uint8), np.array([len(s) for s in strings])
    for k, s in enumerate(strings):
        text[k, : len(s)] = np.frombuffer(s, np.uint8)
    for shallow in (0, 8, 48, 200):
        order, prefix = suffix.deep_shallow_sort(group, text, size, shallow)
        for k in range(1, len(order)):
            a, b = strings[order[k - 1]], strings[order[k]]
            if group[order[k - 1]] != group[order[k]]:
                assert prefix[k] == -1
            else:
                pad = lambda s: s + b"\0" * (100 - len(s))
                assert pad(a) <= pad(b)
                assert prefix[k] <= suffix.common_prefix(a, b)
                assert prefix[k] == suffix.common_prefix(a, b) or pad(a)[: prefix[k] + 1] == pad(b)[: prefix[k] + 1]


def test_short_and_empty(spark):
    df = spark.createDataFrame([(1, "short"), (2, "short")], "doc_id long, text string")
    assert [r.n_removed for r in suffix.digests(df).collect()] == [0, 0]
    assert suffix.digests(df.limit(0)).count() == 0
    assert sorted(r.text for r in suffix.remove_repeats(df).collect()) == ["short", "short"]


def test_whole_windows_are_hashed():
    """Windows that differ in any one byte differ in both hashes."""
    rng = random.Random(2)
    window = bytes(rng.randrange(256) for _ in range(100))
    made = [window] + [window[:k] + bytes([window[k] ^ 1]) + window[k + 1 :] for k in range(100)]
    a = np.frombuffer(b"".join(made), np.uint8)
    for h in suffix.window_hashes(a, np.arange(101) * 100):
        assert len(set(h.tolist())) == 101


def test_anchors_are_the_same_in_any_batch():
    rng = random.Random(5)
    texts = [bytes(rng.randrange(97, 100) for _ in range(rng.randint(90, 700))) for _ in range(60)]

    def found(groups):
        out = set()
        for g in groups:
            a, begin, size = suffix._laid_out(g)
            x = suffix.anchors(a, begin, size)
            out |= {(g[d], int(at - begin[d]), int(f - begin[d]), int(z - begin[d])) for d, at, f, z in zip(x["doc"], x["at"], x["first"], x["last"], strict=True)}
        return out

    assert found([texts]) == found([[t] for t in texts]) == found([texts[:7], texts[7:40], texts[40:]])


def test_a_long_text_is_taken_in_stretches():
    """Memory follows the stretch, not the text, and windows over its borders count."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, 6_000_000, dtype=np.uint8).tobytes().decode()
    text = body + body[suffix.STRETCH_BYTES - 60 : suffix.STRETCH_BYTES + 60]
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([0], pa.int64()), pa.array([text], pa.string())], ["id", "row", "text"])
    tracemalloc.start()
    first = pa.Table.from_batches(list(suffix._find_anchors(1, 1, np.zeros(0, np.uint64))([batch])))
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    packed = pa.Table.from_batches(list(suffix._pack_documents(1)([batch])))
    got = suffix._finish(packed, suffix._settle_windows(1)(suffix._fetch_contexts(1, 1)(packed, suffix._settle_contexts(1)(first)))).to_pylist()
    assert [(r["n_removed"], r["n_spans"]) for r in got] == [(120, 1)]


def test_the_sort_decides_what_hashes_do_not(monkeypatch):
    """Passages repeated in part, in new surroundings, have no equal contexts at their edges: there the sort removes."""
    import pyarrow as pa

    rows = made()
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["id", "row", "text"])
    first = pa.Table.from_batches(list(suffix._find_anchors(1, 1, np.zeros(0, np.uint64))([batch])))
    settled = suffix._settle_contexts(1)(first)
    packed = pa.Table.from_batches(list(suffix._pack_documents(1)([batch])))
    removed = lambda table: sum(sum(b - a for a, b in runs) for _, _, runs in suffix._remove(packed, table))
    by_hash = removed(settled)
    whole = removed(suffix._settle_windows(1)(suffix._fetch_contexts(1, 1)(packed, settled)))
    assert by_hash < whole and whole == sum(r[2] for r in brute(rows))
