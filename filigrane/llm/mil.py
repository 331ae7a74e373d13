"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; every passage of the whole
text is encoded, none is left out, in training as in scoring. An encoder maps a
passage's measures to a hidden vector, gated attention (Ilse, Tomczak and Welling,
2018) weighs the passages, and the weighted mean is scored. Only documents have
labels; which passages matter is learned.

Training: a sample of about ``TRAIN_DOCS`` labelled documents, chosen by a hash of
their id. Of these, in the order of another hash, each is taken whose passages
fit in what is left of ``TRAIN_PASSAGES``; bags are never cut. Their measures go to the driver
(TRAIN_PASSAGES rows of floats at most), where the few hundred weights are fitted
by Adam. Scoring reads every row and every passage.

Measures are taken with numpy over the code points of many texts at once.

Memory: a worker holds one Arrow batch and the arrays of at most ``STRETCH_CHARS``
characters, beyond which a text is measured in stretches of whole passages, and
the measures of one document's passages; nothing is shuffled but the sample.

Edge cases: a null or empty text is one passage of zero measures. Without both
classes in the sample every score is the share of label 1 in it (0.5 if there
are no labels). Ties of the sample's hashes go by id. Only id and text columns are
read, whatever the others are called; repeated rows give repeated results; an
empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.llm.labels import labelled_sample, remainder
from filigrane.llm.state import cut

MOD, HELD_OUT = 4, 2
PASSAGE = 64
TRAIN_DOCS, TRAIN_PASSAGES = 6000, 60_000
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY, SEED = 16, 8, 300, 0.02, 1e-4, 7
PREDICT_AT = 0.7
STRETCH_CHARS = 1 << 20  # characters measured at once

_SYMBOLS = "#*$%&|<>{}[]=\\^~_@/"
_POINTS = ".,;:!?"
#: Frequent function words of four languages.
_STOP = frozenset("a an and are as at be by for from in is it of on or that the this to was with das der die ein eine für ist mit nicht und von zu den auf im au aux dans de des du en est et la le les par pas pour que qui sur un une con del el los no por se su y es para".split())
MEASURES = ("words", "chars", "mean_word", "spread_word", "longest", "symbols", "symbol_kinds", "pipes", "points", "word_end_symbols", "digits", "upper", "not_ascii", "lines", "stop", "distinct", "repeats", "top_share", "single", "capital_words")
_WHOLE = re.compile(rf"[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){{1,{64 * PASSAGE}}}+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _word_hashes(points: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each word, from its code points and their places in it; first: where each word begins in points."""
    return np.add.reduceat(_mixed(points.astype(np.uint64) | place.astype(np.uint64) << np.uint64(21)), first)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: number of the symbol, or -1; whether a point; whether upper case. And the hashes of stop words."""
    symbol, point = np.full(0x110000, -1, np.int8), np.zeros(0x110000, bool)
    symbol[[ord(c) for c in _SYMBOLS]] = np.arange(len(_SYMBOLS))
    point[[ord(c) for c in _POINTS]] = True
    upper = np.array([chr(c).isupper() for c in range(0x110000)])
    stop = [np.array([ord(c) for c in w]) for w in sorted(_STOP)]
    return symbol, point, upper, np.array([_word_hashes(w, np.arange(len(w)), np.array([0]))[0] for w in stop])


def _measured(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Measures of every passage of the texts laid end to end, one row each, and the number of passages of each text."""
    size = np.array([len(t) for t in texts])
    cp = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(size + 1) - size - 1
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    after = np.concatenate(([True], space[:-1]))
    start, end = np.flatnonzero(~space & after), np.flatnonzero(space & ~after)
    doc = np.searchsorted(begin, start, "right") - 1
    words = np.bincount(doc, minlength=len(texts))
    passages = np.maximum(1, -(-words // PASSAGE))
    total = int(passages.sum())
    out = np.zeros((total, len(MEASURES)), np.float32)
    if not len(start):
        return out, passages
    own = (np.cumsum(passages) - passages)[doc] + (np.arange(len(doc)) - (np.cumsum(words) - words)[doc]) // PASSAGE
    new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    at, last = own[new], np.concatenate((new[1:], [len(own)])) - 1
    symbol, point, upper, stop = _tables()
    length = end - start
    first = np.cumsum(length) - length
    c, word = cp[~space], np.repeat(np.arange(len(start)), length)
    hashes = _word_hashes(c, np.arange(len(c)) - np.repeat(first, length), first)
    per_word = lambda x: np.add.reduceat(x, new).astype(np.float64)
    per_char = lambda x: np.add.reduceat(x.astype(np.int64), first[new]).astype(np.float64)
    n, chars = per_word(np.ones(len(start))), per_word(length)
    kind = symbol[c]
    marks = np.flatnonzero(kind >= 0)
    rank = np.repeat(np.arange(len(new)), np.diff(np.concatenate((new, [len(own)]))))
    symbols = np.bincount(rank[word[marks]] * len(_SYMBOLS) + kind[marks], minlength=len(new) * len(_SYMBOLS)).reshape(len(new), -1)
    lines = np.concatenate(([0], np.cumsum(cp == 10)))
    keyed = np.sort(rank.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    runs = np.flatnonzero(np.concatenate(([True], keyed[1:] != keyed[:-1])))
    of_run = (keyed[runs] >> np.uint64(40)).astype(np.int64)
    often = np.diff(np.concatenate((runs, [len(keyed)])))
    head = np.flatnonzero(np.concatenate(([True], of_run[1:] != of_run[:-1])))
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (rank[1:] == rank[:-1])))
    mean = chars / n
    out[at] = np.stack(
        [
            n / PASSAGE,
            (end[last] - start[new]) / (8 * PASSAGE),
            mean / 8,
            np.sqrt(np.maximum(per_word(length * length) / n - mean * mean, 0)) / 8,
            np.minimum(np.maximum.reduceat(length, new), 100) / 50,
            symbols.sum(1) / chars,
            (symbols > 0).sum(1) / 8,
            symbols[:, _SYMBOLS.index("|")] / n,
            per_char(point[c]) / n,
            per_word(symbol[cp[end - 1]] >= 0) / n,
            per_char((c >= 48) & (c <= 57)) / chars,
            per_char(upper[c]) / chars,
            per_char(c > 127) / chars,
            (lines[end[last]] - lines[start[new]]) / n,
            per_word(np.isin(hashes, stop)) / n,
            np.diff(np.concatenate((head, [len(runs)]))) / n,
            per_word(same) / n,
            np.maximum.reduceat(often, head) / n,
            per_word(length == 1) / n,
            per_word(upper[cp[start]]) / n,
        ],
        1,
    )
    return out, passages


def bags(texts: Iterable[str | None]) -> Iterator[list[np.ndarray]]:
    """Measures of every passage of each text, one row each, in groups of texts of about STRETCH_CHARS characters."""
    held, size = [], 0

    def group() -> list[np.ndarray]:
        rows, passages = _measured(held)
        return np.split(rows, np.cumsum(passages)[:-1])

    for text in texts:
        text = text or ""
        if held and size + len(text) > STRETCH_CHARS:
            yield group()
            held, size = [], 0
        if len(text) > STRETCH_CHARS and (parts := [_measured([m[0]])[0] for m in _WHOLE.finditer(text)]):
            yield [np.concatenate(parts)]
        else:
            held.append(text if len(text) <= STRETCH_CHARS else "")
            size += len(held[-1])
    if held:
        yield group()


def encode(text: str | None) -> np.ndarray:
    """Measures of every passage of a text, one row each."""
    return next(bags([text]))[0]


@dataclass
class Model:
    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    a = (t * g) @ w["w"]
    a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
    a = a / np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(h * a[:, None], starts)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["b"], -30, 30)))}


def _gradient(w: dict[str, np.ndarray], f: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * w["o"]
    da = (f["h"] * dz[bag]).sum(1)
    da = f["a"] * (da - np.add.reduceat(da * f["a"], starts)[bag])
    dt, dg = (da[:, None] * w["w"]) * f["g"] * (1 - f["t"] ** 2), (da[:, None] * w["w"]) * f["t"] * f["g"] * (1 - f["g"])
    dh = dz[bag] * f["a"][:, None] + dt @ w["V"].T + dg @ w["U"].T
    de = dh * (1 - f["h"] ** 2)
    return {"E": x.T @ de, "e": de.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ da, "o": f["z"].T @ d, "b": np.array([d.sum()])}


def train(bags: list[np.ndarray], y: np.ndarray) -> Model:
    """Fit by full-batch Adam. Bags may be of any size."""
    y = np.asarray(y, np.float32)
    zero, one = np.zeros(len(MEASURES)), np.ones(len(MEASURES))
    if not len(y) or y.min() == y.max():
        return Model(zero, one, {}, float(y.mean()) if len(y) else 0.5)
    x = np.concatenate(bags)
    sizes = np.array([len(b) for b in bags])
    starts, bag = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(bags)), sizes)
    shift, scale = x.mean(0, np.float64), x.std(0, dtype=np.float64) + 1e-3
    x = np.clip((x - shift) / scale, -8, 8).astype(np.float32)
    rng = np.random.default_rng(SEED)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    zeros = lambda n: np.zeros(n, np.float32)
    w = {"E": draw(len(MEASURES), HIDDEN), "e": zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "o": draw(HIDDEN), "b": zeros(1)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        grad = _gradient(w, _forward(w, x, starts, bag), x, starts, bag, y)
        for k in w:
            g = grad[k] + DECAY * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(shift, scale, w)


def predict(model: Model, bags: list[np.ndarray]) -> np.ndarray:
    if model.constant is not None or not bags:
        return np.full(len(bags), model.constant if model.constant is not None else 0.5)
    sizes = np.array([len(b) for b in bags])
    starts, bag = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(bags)), sizes)
    x = np.clip((np.concatenate(bags) - model.shift) / model.scale, -8, 8).astype(np.float32)
    return _forward(model.weights, x, starts, bag)["p"]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Model:
    """Train on the bounded sample of the rows outside the held-out part."""
    sample = labelled_sample(docs, labels, label, MOD, HELD_OUT, TRAIN_DOCS, id_col, text_col)

    @F.pandas_udf("binary")
    def measures(texts: pd.Series) -> pd.Series:
        return pd.Series([b.tobytes() for group in bags(texts) for b in group], dtype=object)

    measured = cut(sample.select("_id", "_label", F.xxhash64("_id").alias("_h"), measures("_text").alias("_m")))
    left, ids = TRAIN_PASSAGES, []
    for r in sorted(measured.select("_h", "_id", (F.octet_length("_m") / (4 * len(MEASURES))).cast("long").alias("n")).collect()):
        if r.n <= left:
            ids.append((r._id,))
            left -= r.n
    chosen = docs.sparkSession.createDataFrame(ids, measured.select("_id").schema)
    rows = sorted((r._h, r._id, r._label, bytes(r._m)) for r in measured.join(F.broadcast(chosen), "_id").collect())
    return train([np.frombuffer(m, np.float32).reshape(-1, len(MEASURES)) for *_, m in rows], np.array([y for _, _, y, _ in rows]))


def score_column(model: Model, text: Column, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series(np.concatenate([predict(m, group) for group in bags(texts)] or [np.zeros(0)]), dtype="float64")

    return score(text)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    model = fit(docs, labels)
    d = docs.select("doc_id", score_column(model, F.col("text"), docs.sparkSession).alias("score"))
    return d.select("doc_id", (remainder("doc_id", MOD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
