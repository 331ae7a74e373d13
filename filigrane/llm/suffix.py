"""Removal of repeated byte passages by sparse suffix sorting.

A byte goes if some string of ``LENGTH`` bytes over it also starts earlier.
Such strings are found through anchors: the least hash of the ``GRAM``-byte
grams of a window, leftmost first, depends on the window's bytes alone, so equal
windows pick equal grams at equal offsets. The windows that share an anchor are
a run, and the bytes they span are its context.

1. Each task hashes its documents with numpy, and settles equal contexts of its
   own at once: all but the earliest are removed.
2. Anchors meet by gram in buckets, as packed arrays. Contexts that are equal
   as a whole are settled by two independent 64-bit hashes of all their bytes. Only
   the first of each kind goes on, and only if its gram has other contexts.
3. Those contexts' bytes are fetched, and the suffixes that start at the anchors
   are sorted, and likewise the reversed prefixes before them: a multikey sort
   by 8-byte characters down to ``SHALLOW`` bytes, then a blind trie for each
   group that still shares its prefix. From both orders and their common
   prefix lengths follow the classes of equal windows at every offset; the
   earliest of a class stays.
4. Documents meet their removed ranges, and what is left is hashed.

Grams of very many contexts aren't gathered in one task. A sample of
``SAMPLE_DOCS`` documents names those that at least ``SAMPLE_CONTEXTS`` different
contexts share in it; their windows are hashed one by one (two hashes of all 100
bytes), each task keeps the
earliest of equal ones, and the rest spread by window. What the sample misses
and a bucket then finds (over ``HOT_CONTEXTS``) goes the same way one step later. The
sample steers load only; results don't depend on it.

Memory: hashing takes some 90 bytes for each byte of a batch, so texts go in
stretches of ``STRETCH_BYTES``, which overlap by a window's length, and anchors
don't depend on how texts are parted or put together. Beyond that tasks hold one
part's documents or one bucket's arrays; the number of buckets follows the bytes of
the input. No list of documents, grams or windows reaches the driver.

Edge cases: documents count in the order of id, rows of one id in the order of
the table; a null id is the largest, a null text is empty. Texts under LENGTH
bytes lose nothing; a text of any length is taken whole. Of equal strings the first
stays, so ties can't arise. Only the id and text columns are read, whatever the
others are called; an empty table gives an empty one. Rows are told apart by their
place in the table, so it must give them in the same order when it is read
again: stored tables do, anything else is stored first (``stored=False``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.llm.state import cut

LENGTH, GRAM = 100, 32
SHALLOW = 48
HOT_CONTEXTS = 50_000
SAMPLE_DOCS, SAMPLE_CONTEXTS = 4_000, 24
BATCH_BYTES, STRETCH_BYTES = 2 << 20, 1 << 20
_PLACE_BITS = 22  # of a place in a batch
BUCKET_BYTES, PART_BYTES, LEAST_TASKS = 12 << 20, 16 << 20, 8
NO_ID = (1 << 63) - 1
_SPAN = LENGTH - GRAM + 1  # grams in a window
_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F)
_TABLES = np.random.default_rng(20240229).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_ROWS = "to int, kind int, data binary"


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any stretch of a buffer, equal for equal bytes wherever they stand. The two kinds are independent."""

    def __init__(self, a: np.ndarray, kind: int = 0) -> None:
        n = len(a)
        power = np.full(n + 1, _BASES[kind], np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLES[kind][a] * power[:n], out=self.sums[1:])
        power[1:] = np.uint64(pow(_BASES[kind], -1, 1 << 64))
        power[0] = 1
        self.back = np.multiply.accumulate(power, out=power)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def window_hashes(a: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window: two hashes of all its bytes."""
    return tuple(Hashes(a, kind)(start, start + LENGTH) for kind in (0, 1))


def _stretches(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the closed ranges, and the range of each."""
    count = last - first + 1
    which = np.repeat(np.arange(len(first)), count)
    return np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which], which


def anchors(a: np.ndarray, begin: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of all windows of the texts laid end to end in a: doc (index), at, first and last window start (in a), gram and two context hashes.

    A window's anchor is the gram with the least hash, cut to the bits over its place in the batch, and of equal ones the leftmost."""
    n = len(a)
    if n < LENGTH:
        types = (("doc", np.int64), ("at", np.int64), ("first", np.int64), ("last", np.int64), ("gram", np.uint64), ("context", np.uint64), ("other", np.uint64))
        return {k: np.zeros(0, t) for k, t in types}
    hashes = Hashes(a)
    where = np.arange(n - GRAM + 1)
    gram = hashes(where, where + GRAM)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = _sliding_min((gram & ~low) | where.astype(np.uint64), _SPAN)
    at = (least & low).astype(np.int64)
    doc = np.repeat(np.arange(len(begin)), size)[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + LENGTH <= (begin + size)[doc])
    at, doc = at[start], doc[start]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))) if len(at) else np.zeros(0, np.int64)
    first, last = start[new], start[np.concatenate((new[1:] - 1, [len(at) - 1]))] if len(at) else start
    at, doc = at[new], doc[new]
    shape = ((at - first) * LENGTH + (last - first)).astype(np.uint64)
    gram = gram[at]
    del where, least, start
    context, other = (_mix(h(first, last + LENGTH) + shape * np.uint64(base)) for h, base in ((hashes, _BASES[0]), (Hashes(a, 1), _BASES[1])))
    return {"doc": doc, "at": at, "first": first, "last": last, "gram": gram, "context": context, "other": other}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob. All have the length of the first."""
    return zstandard.compress(b"".join([len(arrays[0]).to_bytes(8, "little"), *[np.ascontiguousarray(x).tobytes() for x in arrays]]), 1)


def unpack(blob: bytes, types: tuple) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _gathered(blobs: list[bytes], types: tuple) -> list[np.ndarray]:
    parts = [unpack(b, types) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(types)]


_ANCHOR = (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int32, np.uint8, np.uint8)  # gram, two hashes of the context, id, row, at, at - first, last - first
_EDGE = (np.uint64, np.int64, np.int64, np.int32, np.uint8, np.uint8, np.bool_)  # gram, id, row, at, before, run, hot
_RANGE = (np.int64, np.int64, np.int32, np.int32)  # id, row, start, end
_CONTEXT = (np.uint64, np.int64, np.int64, np.int32, np.uint8, np.uint8, f"V{2 * LENGTH}")
_WINDOW = (np.uint64, np.uint64, np.int64, np.int64, np.int32)


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())], ["to", "kind", "data"])


def _dealt(kind: int, to: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One blob for each target."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(to[order])) + 1, [len(to)]))
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        own = order[s:e]
        yield int(to[own[0]]), kind, pack(*[x[own] for x in arrays])


def _part(row: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(row.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


#: Kinds of rows. Each step deals all its rows by the key of the next one and hands on what it doesn't use, so every step is computed once.
ANCHORS, EDGES, DOCUMENTS, CONTEXTS, WINDOWS, RANGES = range(6)


def _of(table: pa.Table, kind: int, types: tuple) -> list[np.ndarray]:
    kinds, blobs = table.column("kind").to_pylist(), table.column("data").to_pylist()
    return _gathered([b for k, b in zip(kinds, blobs, strict=True) if k == kind], types)


def _ranges(targets: int, parts: int, ids: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Removed ranges on their way to their documents' part, by way of that many targets."""
    return _dealt(RANGES, _part(row, parts) % targets, ids, row, start.astype(np.int32), end.astype(np.int32))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Documents in groups of about BATCH_BYTES: ids, rows, texts."""
    ids, rows, texts, held = [], [], [], 0
    for b in batches:
        for i, r, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            t = (t or "").encode("utf-8", "surrogatepass")
            ids.append(NO_ID if i is None else i)
            rows.append(r)
            texts.append(t)
            held += len(t)
            if held >= BATCH_BYTES:
                yield np.array(ids, np.int64), np.array(rows, np.int64), texts
                ids, rows, texts, held = [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.int64), texts


def _stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Ids, rows, offsets and bytes of stretches of the documents, in groups of less than 1 << _PLACE_BITS bytes.

    Stretches of one text overlap by all but one byte of a window, so each window is in one of them."""
    ids, rows, offsets, parts, held = [], [], [], [], 0
    for own_ids, own_rows, texts in _batches(batches):
        for i, r, t in zip(own_ids, own_rows, texts, strict=True):
            for at in range(0, max(1, len(t) - LENGTH + 1), STRETCH_BYTES):
                part = t[at : at + STRETCH_BYTES + LENGTH - 1]
                if held + len(part) > BATCH_BYTES and held:
                    yield np.array(ids, np.int64), np.array(rows, np.int64), np.array(offsets, np.int64), parts
                    ids, rows, offsets, parts, held = [], [], [], [], 0
                for x, v in ((ids, i), (rows, r), (offsets, at), (parts, part)):
                    x.append(v)
                held += len(part)
    if parts:
        yield np.array(ids, np.int64), np.array(rows, np.int64), np.array(offsets, np.int64), parts


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end, and where each begins and how long it is."""
    size = np.array([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(size)[:-1])), size


def _find_anchors(buckets: int, parts: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, offsets, texts in _stretched(batches):
            a, begin, size = _laid_out(texts)
            begin_of = begin - offsets  # where the document would begin
            x = anchors(a, begin, size)
            found: list = []
            many = np.isin(x["gram"], hot)
            if many.any():
                start, which = _stretches(x["first"][many], x["last"][many])
                d = x["doc"][many][which]
                found += _spread(buckets, parts, *window_hashes(a, start), ids[d], rows[d], (start - begin_of[d]).astype(np.int32))
                x = {k: v[~many] for k, v in x.items()}
            doc, base = x["doc"], begin_of[x["doc"]]
            order = np.lexsort((x["at"] - base, rows[doc], ids[doc], x["other"], x["context"], x["gram"]))
            gram, context, other = x["gram"][order], x["context"][order], x["other"][order]
            again = np.concatenate(([False], (gram[1:] == gram[:-1]) & (context[1:] == context[:-1]) & (other[1:] == other[:-1]))) if len(order) else np.zeros(0, bool)
            gone, kept = order[again], np.sort(order[~again])
            found += _ranges(buckets, parts, ids[doc[gone]], rows[doc[gone]], (x["first"] - base)[gone], (x["last"] - base)[gone] + LENGTH)
            at, d = (x["at"] - base)[kept].astype(np.int32), doc[kept]
            to = (x["gram"][kept] >> np.uint64(8)) % np.uint64(buckets)
            found += _dealt(ANCHORS, to.astype(np.int64), x["gram"][kept], x["context"][kept], x["other"][kept], ids[d], rows[d], at, (x["at"] - x["first"])[kept].astype(np.uint8), (x["last"] - x["first"])[kept].astype(np.uint8))
            if found:
                yield _rows(found)

    return run


def _later(h: np.ndarray, half: np.ndarray, ids: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows by their hashes: places of the earliest of each kind, and of the others."""
    order = np.lexsort((start, row, ids, half, h))
    again = np.concatenate(([False], (h[order][1:] == h[order][:-1]) & (half[order][1:] == half[order][:-1]))) if len(order) else np.zeros(0, bool)
    return order[~again], order[again]


def _spread(targets: int, parts: int, h: np.ndarray, half: np.ndarray, ids: np.ndarray, row: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Windows dealt out by their hash, of equal ones the earliest; the others' ranges."""
    first, again = _later(h, half, ids, row, start)
    yield from _merged(targets, parts, ids[again], row[again], start[again])
    yield from _dealt(WINDOWS, (h[first] % np.uint64(targets)).astype(np.int64), h[first], half[first], ids[first], row[first], start[first])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, context) of every anchor, each pair once a batch."""
    for *_, texts in _stretched(batches):
        x = anchors(*_laid_out(texts))
        pairs = np.unique(np.stack([x["gram"], x["context"]], 1), axis=0).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["gram", "context"])


def hot_grams(d: DataFrame, rows: int) -> np.ndarray:
    """Grams with many different contexts in a sample; at most the sample's anchors over SAMPLE_CONTEXTS."""
    share = min(1.0, SAMPLE_DOCS / max(1, rows))
    part = d.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))
    pairs = part.mapInArrow(_sampled, "gram long, context long").distinct()
    found = pairs.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_CONTEXTS).select("gram").collect()
    return np.sort(np.array([r.gram for r in found], np.int64).view(np.uint64))


def _settle_contexts(parts: int):
    """A bucket's anchors: removed ranges of contexts that are equal as a whole, and the contexts to compare in part."""

    def run(table: pa.Table) -> pa.Table:
        found = [*_ranges(parts, parts, *_of(table, RANGES, _RANGE)), *_spread(parts, parts, *_of(table, WINDOWS, _WINDOW))]
        gram, context, other, ids, row, at, before, span = _of(table, ANCHORS, _ANCHOR)
        if not len(gram):
            return pa.Table.from_batches([_rows(found)])
        order = np.lexsort((at, row, ids, other, context, gram))
        gram, context, other, ids, row, at, before, span = (x[order] for x in (gram, context, other, ids, row, at, before, span))
        same_gram = np.concatenate(([False], gram[1:] == gram[:-1]))
        again = same_gram & np.concatenate(([False], (context[1:] == context[:-1]) & (other[1:] == other[:-1])))
        first = at - before
        found += _ranges(parts, parts, ids[again], row[again], first[again], first[again] + span[again] + LENGTH)
        heads = np.flatnonzero(~again)
        group = np.cumsum(~same_gram)[heads]
        count = np.bincount(group)[group] if len(heads) else group
        edge, hot = heads[count > 1], (count > HOT_CONTEXTS)[count > 1]
        found += _dealt(EDGES, _part(row[edge], parts), gram[edge], ids[edge], row[edge], at[edge], before[edge], span[edge], hot)
        return pa.Table.from_batches([_rows(found)])

    return run


def _pack_documents(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, texts in _batches(batches):
            to, found = _part(rows, parts), []
            for part in np.unique(to):
                own = np.flatnonzero(to == part)
                head = pack(ids[own], rows[own], np.array([len(texts[i]) for i in own], np.int64))
                found.append((int(part), DOCUMENTS, len(head).to_bytes(4, "little") + head + zstandard.compress(b"".join([texts[i] for i in own]), 1)))
            yield _rows(found)

    return run


def _documents(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    for blob in table.column("data"):
        blob = blob.as_py()
        k = 4 + int.from_bytes(blob[:4], "little")
        text, at = zstandard.decompress(blob[k:]), 0
        for i, r, n in zip(*(x.tolist() for x in unpack(blob[4:k], (np.int64, np.int64, np.int64))), strict=True):
            yield i, r, text[at : at + n]
            at += n


def _by_row(row: np.ndarray) -> dict[int, tuple[int, int]]:
    """Stretches of a sorted array by value."""
    edges = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1, [len(row)])) if len(row) else np.zeros(1, np.int64)
    return {int(row[s]): (int(s), int(e)) for s, e in zip(edges[:-1], edges[1:], strict=True)}


def _fetch_contexts(buckets: int, parts: int):
    """Bytes of the contexts to compare; of hot grams, the hash of every window."""

    def run(docs: pa.Table, edges: pa.Table) -> pa.Table:
        found = [*_ranges(buckets, parts, *_of(edges, RANGES, _RANGE)), *_spread(buckets, parts, *_of(edges, WINDOWS, _WINDOW))]
        gram, ids, row, at, before, span, hot = _of(edges, EDGES, _EDGE)
        order = np.argsort(row, kind="stable")
        gram, ids, row, at, before, span, hot = (x[order] for x in (gram, ids, row, at, before, span, hot))
        text, places = np.zeros((len(row), 2 * LENGTH), np.uint8), _by_row(row)
        seen: list[list[np.ndarray]] = []
        for _, r, t in _documents(docs):
            if r not in places:
                continue
            s, e = places[r]
            a = np.frombuffer(t, np.uint8)
            first, end = (at[s:e] - before[s:e]).astype(np.int64), at[s:e].astype(np.int64) - before[s:e] + span[s:e] + LENGTH
            for k, (x, y) in enumerate(zip(first.tolist(), end.tolist(), strict=True), s):
                text[k, : y - x] = a[x:y]
            for k in np.flatnonzero(hot[s:e]).tolist():
                starts = np.arange(first[k], end[k] - LENGTH + 1)
                seen.append([*window_hashes(a[first[k] : end[k]], starts - first[k]), np.full(len(starts), ids[s]), np.full(len(starts), r), starts.astype(np.int32)])
        cold = ~hot
        to = ((gram >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
        found += _dealt(CONTEXTS, to[cold], gram[cold], ids[cold], row[cold], at[cold], before[cold], span[cold], text[cold].reshape(-1).view(f"V{2 * LENGTH}") if cold.any() else np.zeros(0, f"V{2 * LENGTH}"))
        if seen:
            found += _spread(buckets, parts, *(np.concatenate([x[k] for x in seen]) for k in range(5)))
        return pa.Table.from_batches([_rows(found)])

    return run


class BlindTrie:
    """Orders strings by a trie that keeps branching places only; a string is compared in full with one leaf on its way."""

    def __init__(self) -> None:
        self.root: list | None = None  # leaf: [string, [numbers]]; branch: [depth, {byte or -1: child}]

    def add(self, s: bytes, number: int) -> None:
        if self.root is None:
            self.root = [s, [number]]
            return
        node = self.root
        while isinstance(node[0], int):  # blindly down
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = node[0]
        if other == s:
            node[1].append(number)
            return
        depth = common_prefix(s, other)
        holder, key, node = None, None, self.root
        while isinstance(node[0], int) and node[0] < depth:
            holder, key = node[1], s[node[0]] if node[0] < len(s) else -1
            node = holder[key]
        c, leaf = (s[depth] if depth < len(s) else -1), [s, [number]]
        if isinstance(node[0], int) and node[0] == depth:
            node[1][c] = leaf
            return
        made = [depth, {c: leaf, (other[depth] if depth < len(other) else -1): node}]
        if holder is None:
            self.root = made
        else:
            holder[key] = made

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(number, length of the prefix shared with the one before), in the order of the strings; equal strings share their whole length."""
        todo, shared = [(self.root, 0)] if self.root else [], 0
        while todo:
            node, shared_before = todo.pop()
            if isinstance(node[0], int):
                kids = sorted(node[1].items())
                todo.extend([(kid, node[0]) for _, kid in kids[:0:-1]] + [(kids[0][1], shared_before)])
            else:
                shared = shared_before
                for n in node[1]:
                    yield n, shared
                    shared = len(node[0])


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def deep_shallow_sort(group: np.ndarray, text: np.ndarray, size: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings (rows of text, zero beyond size) by group, then bytes, then size; and each one's common prefix with the one before, -1 in a new group.

    Multikey steps by 8-byte characters part the strings that differ early; what still shares ``shallow`` bytes is left to blind tries."""
    n, width = text.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = text
    keys = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    tie = np.concatenate(([False], np.diff(group[order]) == 0)) if n else np.zeros(0, bool)  # equal so far to the one before
    prefix = np.where(tie, 0, -1)
    for k in range(min(shallow // 8, keys.shape[1])):
        run = np.cumsum(~tie)
        busy = np.flatnonzero(tie | np.concatenate((tie[1:], [False])))
        if not len(busy):
            break
        part = busy[np.lexsort((keys[order[busy], k], run[busy]))]
        order[busy] = order[part]
        key = keys[order[busy], k]
        differ = key[1:] ^ key[:-1]
        inside = tie[busy][1:]
        split = busy[1:][inside & (differ != 0)]
        bits = differ[inside & (differ != 0)]
        prefix[split] = 8 * k + (63 - np.floor(np.log2(np.maximum(bits >> np.uint64(32), np.uint64(1)).astype(np.float64))).astype(np.int64) - 32) // 8
        small = bits < np.uint64(1 << 32)
        prefix[split[small]] = 8 * k + 4 + (31 - np.floor(np.log2(bits[small].astype(np.float64))).astype(np.int64)) // 8
        tie[split] = False
    edges = np.flatnonzero(~tie)
    ends = np.append(edges[1:], n)
    for s, e in zip(edges[ends - edges > 1].tolist(), ends[ends - edges > 1].tolist(), strict=True):
        trie, own = BlindTrie(), order[s:e].copy()
        for j in own.tolist():
            trie.add(text[j, : size[j]].tobytes(), j)
        for k, (j, shared) in enumerate(trie.ordered(), s):
            order[k] = j
            if k > s:
                prefix[k] = shared
    short = np.minimum(size[order], np.concatenate(([width], size[order][:-1]))) if n else size
    return order, np.minimum(prefix, np.where(prefix < 0, -1, short))


def repeated_windows(gram: np.ndarray, at: np.ndarray, before: np.ndarray, span: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in document order → (which, start) of every window that an earlier context of its gram also has."""
    n = len(gram)
    before, span = before.astype(np.int64), span.astype(np.int64)
    low, size = before - span, span + LENGTH
    group = np.unique(gram, return_inverse=True)[1]
    spot = np.arange(LENGTH)
    right = np.where(spot < (size - before)[:, None], np.take_along_axis(text, np.minimum(before[:, None] + spot, text.shape[1] - 1), 1), 0)
    back = np.arange(_SPAN)
    left = np.where(back < before[:, None], np.take_along_axis(text, np.maximum(before[:, None] - 1 - back, 0), 1), 0)
    sides = []
    for strings, length in ((left, before), (right, size - before)):
        order, prefix = deep_shallow_sort(group, strings.astype(np.uint8), length)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        sides.append((rank, prefix))
    which, starts = [], []
    for offset in range(_SPAN):
        own = np.flatnonzero((low <= offset) & (offset <= before))
        if len(own) < 2:
            continue
        a = np.cumsum(sides[0][1] < offset)[sides[0][0][own]]
        b = np.cumsum(sides[1][1] < LENGTH - offset)[sides[1][0][own]]
        _, head, back_to = np.unique(a * (n + 1) + b, return_index=True, return_inverse=True)
        later = np.flatnonzero(head[back_to] != np.arange(len(own)))
        which.append(own[later])
        starts.append(at[own[later]] - offset)
    return (np.concatenate(which), np.concatenate(starts)) if which else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _settle_windows(parts: int):
    """A bucket's contexts, and hot windows by their hash: removed ranges."""

    def run(table: pa.Table) -> pa.Table:
        found = list(_ranges(parts, parts, *_of(table, RANGES, _RANGE)))
        gram, ids, row, at, before, span, text = _of(table, CONTEXTS, _CONTEXT)
        order = np.lexsort((at, row, ids))
        gram, ids, row, at, before, span, text = (x[order] for x in (gram, ids, row, at, before, span, text))
        if len(order):
            which, start = repeated_windows(gram, at, before, span, np.ascontiguousarray(text).view(np.uint8).reshape(len(order), 2 * LENGTH))
            found += _merged(parts, parts, ids[which], row[which], start)
        h, half, ids, row, start = _of(table, WINDOWS, _WINDOW)
        _, again = _later(h, half, ids, row, start)
        found += _merged(parts, parts, ids[again], row[again], start[again])
        return pa.Table.from_batches([_rows(found)])

    return run


def _merged(targets: int, parts: int, ids: np.ndarray, row: np.ndarray, start: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Ranges of runs of adjacent window starts."""
    if not len(row):
        return []
    order = np.lexsort((start, row))
    ids, row, start = ids[order], row[order], start[order].astype(np.int64)
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)))
    head = np.flatnonzero(new)
    tail = np.append(head[1:] - 1, len(row) - 1)
    return list(_ranges(targets, parts, ids[head], row[head], start[head], start[tail] + LENGTH))


def _remove(docs: pa.Table, ranges: pa.Table) -> Iterator[tuple[int | None, bytes, list[tuple[int, int]]]]:
    """Each document's id, bytes and the maximal runs of them that go."""
    _, row, start, end = _of(ranges, RANGES, _RANGE)
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    places = _by_row(row)
    for i, r, text in _documents(docs):
        s, e = places.get(r, (0, 0))
        runs: list[tuple[int, int]] = []
        for x, y in zip(start[s:e].tolist(), end[s:e].tolist(), strict=True):
            if runs and x <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(y, runs[-1][1]))
            else:
                runs.append((x, y))
        yield None if i == NO_ID else i, text, runs


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def _finish(docs: pa.Table, ranges: pa.Table) -> pa.Table:
    rows = [(i, len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(t, runs)).hexdigest()) for i, t, runs in _remove(docs, ranges)]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _finish_text(docs: pa.Table, ranges: pa.Table) -> pa.Table:
    found = [(i, _kept(t, runs).decode("utf-8", "replace")) for i, t, runs in _remove(docs, ranges)]
    return pa.Table.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["id", "text"])


def _plan(docs: DataFrame, id_col: str, text_col: str, finish, schema: str, stored: bool) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not stored:
        docs = cut(docs)
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets, parts = (max(LEAST_TASKS, -(-total // size)) for size in (BUCKET_BYTES, PART_BYTES))
    d = docs.select("id", F.monotonically_increasing_id().alias("row"), "text")
    first = d.mapInArrow(_find_anchors(buckets, parts, hot_grams(d, rows)), _ROWS)
    packed = d.mapInArrow(_pack_documents(parts), _ROWS).groupBy("to")
    settled = first.groupBy("to").applyInArrow(_settle_contexts(parts), _ROWS)
    contexts = packed.cogroup(settled.groupBy("to")).applyInArrow(_fetch_contexts(buckets, parts), _ROWS)
    ranges = contexts.groupBy("to").applyInArrow(_settle_windows(parts), _ROWS)
    return packed.cogroup(ranges.groupBy("to")).applyInArrow(finish, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """One row a document: id_col, n_bytes, n_removed, n_spans and kept_sha256. stored: docs is a stored table as it is."""
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _plan(docs, id_col, text_col, _finish, schema, stored).withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """One row a document: id_col and what is left of its text; characters cut in part become U+FFFD."""
    return _plan(docs, id_col, text_col, _finish_text, "id long, text string", stored).withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


#: The same digests in DuckDB SQL, for ids that are unique: every window by itself, on texts in hex.
ORACLE = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS win FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM d)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
edges AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM edges) GROUP BY doc_id, i),
gaps AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low, b FROM runs),
kept AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * low + 1, 2 * (a - low)), '' ORDER BY a) AS front FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(front || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
