"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes meets a mask, so equal
passages are cut alike wherever they stand. A chunk is encoded by itself and kept in
a memo: a chunk that the documents of a task share is encoded once. A cut seldom
falls between words, so the joins are repaired: the runs of text at a join are
encoded together with the one before and the one after, by the library and as one
text; if at both ends the ids agree with those of the chunks, what is between
them takes the place of what the chunks had, otherwise the window grows by one
more run on either side until they agree or it is the whole text. Where no white
space stands between several cuts, their chunks are repaired as one.

Inside a chunk, runs between ASCII white space, which every pre-tokenizer piece and
every normalisation stops at, are taken from a second memo; new ones come apart
at the vocabulary's pre-tokenizer pattern, and the library's BPE model encodes
each new piece. Runs with characters whose case, composition or class the library
and Python may see differently, or with an added token, go to the library whole.

Memory: one Arrow batch, the memos (``memo_mb``, emptied when a task ends, as
idle workers keep theirs otherwise) and the vocabulary.
Nothing is shuffled and no state crosses tasks, so a lost task is simply run
again. The vocabulary is read by its path on each executor.

Edge cases: a null or empty text has no tokens, an empty id string and an empty
decoded text. Texts of any length are encoded whole. Only the id and text
columns are read, whatever the others are called; repeated rows give repeated
results, so ties can't matter; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pre-tokenizer pattern of the vocabulary file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters on which Python's case mapping and classes agree with the library's, all of them composed.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e -įĲ-ž‐-‧‰-⁞₠-₿]*")

CHUNK_MASK = np.uint64(0x1FF)
CHUNK_WINDOW, CHUNK_LEAST = 16, 48
MEMO_MB = 160
_SPACE = frozenset(b" \t\n\r\x0b\x0c")


class Memo:
    """A dictionary bounded in bytes, in two halves: when the young half is full it becomes the old one, whose keys come back as they are used.

    An entry counts as ENTRY bytes and WEIGHT more for each of its key's."""

    ENTRY, WEIGHT = 160, 4

    def __init__(self, limit: int) -> None:
        self.limit, self.held, self.young, self.old = limit // 2, 0, {}, {}

    def put(self, key: str | bytes, value: str | tuple) -> None:
        size = self.ENTRY + self.WEIGHT * len(key)
        if self.held + size > self.limit:
            self.held, self.old, self.young = 0, self.young, {}
        self.held += size
        self.young[key] = value

    def clear(self) -> None:
        self.held, self.young, self.old = 0, {}, {}

    def get(self, key: str | bytes) -> str | tuple | None:
        known = self.young.get(key)
        if known is None and (known := self.old.get(key)) is not None:
            self.put(key, known)
        return known


def cuts(data: bytes) -> list[int]:
    """Byte offsets after which a chunk ends: where the hash of the last CHUNK_WINDOW bytes meets the mask, between characters and CHUNK_LEAST bytes after the cut before."""
    n = len(data)
    if n <= CHUNK_WINDOW:
        return []
    a = np.frombuffer(data, np.uint8)
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    span = 1
    while span < CHUNK_WINDOW:
        h[span:] = h[span:] + (h[:-span] * np.uint64(pow(0x100000001B3, span, 1 << 64)))
        span *= 2
    at = np.flatnonzero(((h >> np.uint64(40)) & CHUNK_MASK) == 0) + 1
    at = at[(at >= CHUNK_WINDOW) & (at < n)]
    out, last = [], 0
    for x in at[(a[at] & 0xC0) != 0x80].tolist():
        if x - last >= CHUNK_LEAST:
            out.append(x)
            last = x
    return out


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next letter from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)).difference(plain)))}


class Coder:
    """Encodes and decodes with one vocabulary file whose pieces never hold white space and whose tokens decode joined by spaces."""

    def __init__(self, path: str, memo_mb: int = MEMO_MB) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.model = self.lib.model
        if not getattr(self.model, "end_of_word_suffix", None) or self.lib.decoder is not None:
            raise ValueError("the vocabulary must mark word ends and have no decoder of its own")
        self.special = re.compile("|".join(re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values()) or r"\Z\A.")
        tokens = self.lib.get_vocab(with_added_tokens=True)
        self.written = {i: str(i) for i in tokens.values()}
        self.tokens = {str(i): t for t, i in tokens.items()}
        self.letters = _byte_letters()
        self.chunks, self.joins, self.runs = (Memo(memo_mb * part << 16) for part in (2, 1, 13))
        self.did: Counter = Counter()

    def forget(self) -> None:
        """Give the memos' memory back; a worker outlives its task and may serve other work next."""
        for memo in (self.chunks, self.joins, self.runs):
            memo.clear()

    def _piece(self, piece: str) -> str:
        """A pre-tokenizer piece's ids."""
        if (known := self.runs.get(piece)) is None:
            found = self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))
            known = " ".join([self.written[t.id] for t in found])
            self.runs.put(piece, known)
        return known

    def _library(self, text: str) -> list[str]:
        return [self.written[i] for i in self.lib.encode(text, add_special_tokens=False).ids]

    def _run(self, run: bytes) -> str:
        """Ids of what stands between white space."""
        if (known := self.runs.old.get(run)) is None:
            text = run.decode()
            if PLAIN.fullmatch(text) and not self.special.search(text):
                pieces = PIECES.findall(text.lower())
                if len(pieces) != 1 or pieces[0] != text:
                    known = " ".join([self._piece(w) for w in pieces])
                else:
                    found = self.model.tokenize(text if text.isascii() else run.decode("latin-1").translate(self.letters))
                    known = " ".join([self.written[t.id] for t in found])
            else:
                known = " ".join(self._library(text))
        self.runs.put(run, known)
        return known

    def _chunk(self, chunk: bytes) -> tuple[str, ...]:
        """Ids of each run of a chunk by itself."""
        known = self.chunks.get(chunk)
        if known is None:
            young, other = self.runs.young.get, self._run
            known = tuple([young(r) or other(r) for r in chunk.split()])
            self.chunks.put(chunk, known)
            self.did["chunks"] += 1
        else:
            self.did["reused"] += 1
        return known

    def _mend(self, runs: list[bytes], values: list[str | None], joins: list[tuple[int, int]]) -> None:
        """Ids of the runs at joins, first to last, from windows that agree with the chunks at both ends; the first run takes those of all."""
        reach = 0
        while joins:
            reach += 1
            windows, new = {}, {}
            for first, last in joins:
                low, high = max(0, first - reach), min(len(runs), last + 1 + reach)
                key = (first - low).to_bytes(4, "big") + (high - 1 - last).to_bytes(4, "big") + b" ".join(runs[low:high])
                windows[first, last] = (low, high, key)
                if self.joins.get(key) is None:
                    new[key[8:]] = None
            if new:
                new = dict(zip(new, self.lib.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True))
            found = {}
            for (first, last), (low, high, key) in windows.items():
                if (known := self.joins.get(key)) is None:
                    ids = [self.written[i] for i in new[key[8:]].ids] if key[8:] in new else self._library(key[8:].decode())
                    before, after = values[low:first], values[last + 1 : high]
                    if None not in before and None not in after:
                        before, after = " ".join(before).split(), " ".join(after).split()
                        end = len(ids) - len(after)
                        if len(before) <= end and ids[: len(before)] == before and ids[end:] == after:
                            known = " ".join(ids[len(before) : end])
                            self.joins.put(key, known)
                    if known is None and low == 0 and high == len(runs):
                        values[:] = [" ".join(ids), *[""] * (len(runs) - 1)]
                        return
                if known is not None:
                    found[first, last] = known
            for (first, last), ids in found.items():
                values[first : last + 1] = [ids, *[""] * (last - first)]
            joins = [j for j in joins if j not in found]

    def encode(self, text: str | None) -> tuple[str, int, str]:
        """Ids in decimal joined by one space, their number, and the decoded text."""
        if not text:
            return "", 0, ""
        data = text.encode()
        runs, values, alone, start = data.split(), [], {}, 0
        for end in [*cuts(data), len(data)]:
            own = self._chunk(data[start:end])
            if start and data[start - 1] not in _SPACE and data[start] not in _SPACE:
                at = len(values) - 1
                alone.setdefault(at, [values[at]]).append(own[0])
                own = own[1:]
            values.extend(own)
            start = end
        joins: list[tuple[int, int]] = []
        for at in alone:
            values[at] = None
            joins.append((joins.pop()[0], at) if joins and joins[-1][1] == at - 1 else (at, at))
        self._mend(runs, values, joins)
        for first, last in joins:
            self.did["agreed" if " ".join([x for at in range(first, last + 1) for x in alone[at]]).split() == values[first].split() else "repaired"] += 1
        ids = " ".join(values).split()
        return " ".join(ids), len(ids), " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Coder(path)


@contextmanager
def _task(path: str) -> Iterator[Coder]:
    """The coder for one task, whose memos end with it."""
    c = coder(path)
    try:
        yield c
    finally:
        c.forget()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, ids (array of int) and decoded."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _task(path) as c:
            for b in batches:
                made = [c.encode(t.as_py()) for t in b.column(1)]
                ids = pa.array([[int(i) for i in m[0].split()] for m in made], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([m[2] for m in made], pa.string())], ["id", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_tokens, ids_sha256 and decoded_sha256."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        with _task(path) as c:
            for b in batches:
                made = [(n, sha(i), sha(d)) for i, n, d in (c.encode(t.as_py()) for t in b.column(1))]
                cols = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
