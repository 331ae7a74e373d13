"""Toxicity by maximum-scoring segments.

Learning, on at most about ``TRAIN_DOCS`` labelled documents (held-out rows never
count): a term is a word or the first letters of one (``PREFIXES``), which covers
inflections that no label has shown. A term's weight in a document is 1 + ln of
its occurrences, so no single document makes a term. Terms of ``MIN_DOCS`` toxic
documents or more are tested against the share of toxic weight (a Chernoff bound
of the binomial tail); those that pass at a false discovery rate of ``FALSE_RATE``
over all terms of the toxic documents make the model. A term's score is its
log-odds between the classes with a Dirichlet prior, whose shape is the term's
share in all documents of the corpus, counted in a pass over all of them. With many
labels very small log-odds are significant, too, such as those of a language's
common words; how large they must be is chosen among ``BARS`` by the loss out of sample.

Scoring: a document is a sequence of token scores: the log-odds of the model's
most significant term for the token, and the log-odds of a token outside the model
for all others. One linear scan (Ruzzo and Tompa) finds every maximal scoring
segment. As scores are log-odds, the extreme-value law of segment scores has
rate 1; its constant K is the likeliest for the clean training documents. By
Karlin and Altschul the sum of the r best normalised segments has a known tail; a
document's evidence is the best of it over r from one to all its segments.
Evidence becomes a probability by a logistic curve.

K, the curve and the bar are fitted out of sample: training documents fall in ``FOLDS``
by a hash of their text (copies together) and each is measured by the terms
learned from the other folds.

Scale: the pass for the prior and the scoring run row by row and shuffle one row
a task and term of the model; the model that travels is terms of ``MIN_DOCS`` or more
of the bounded sample's documents.

Edge cases: a null or empty text is one token outside the model. Ties between a
token's terms go to the longer one. Without both classes in the sample, or
without a significant term, every score is the smoothed share of label 1. Texts
of any length are scanned whole. Only id and text columns are read, whatever the
others are called; repeated rows give repeated results; an empty table gives an
empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.llm.labels import labelled_sample, remainder
from filigrane.llm.state import cut

MOD, HELD_OUT = 3, 1
TRAIN_DOCS = 20_000
FOLDS = 5
PREFIXES = (4, 5, 6, 7)
MIN_DOCS = 3
FALSE_RATE = 0.05
PRIOR_SHARE = 0.08  # weight of the prior: this share of the labelled documents' weight
BARS = (0.0, 0.5, 1.0, 2.0, 3.0)  # least log-odds that are tried
PREDICT_AT = 0.7
LOW, HIGH, BIN = -20.0, 60.0, 0.25  # of the evidence, for the curve
FLUSH = 200_000  # terms that a task holds before it hands on their sums
WORD = re.compile(r"[^\W_]+")
_SPACED = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128))  # WORD over ASCII, as a table for translate


@dataclass
class Model:
    """terms: score and significance of words and, marked by ^, of first letters; gap: score of any other token."""

    terms: dict[str, tuple[float, float]] = field(default_factory=dict)
    gap: float = -0.1
    constant: float = 0.01  # K of the extreme-value law
    slope: float = 0.0
    offset: float = 0.0
    heads: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.heads = frozenset(t.removeprefix("^")[: PREFIXES[0]] for t in self.terms)


def terms_of(word: str) -> Iterator[str]:
    """The word and its marked first letters, the longest first."""
    yield word
    for k in reversed(PREFIXES):
        if len(word) > k:
            yield "^" + word[:k]


def words(text: str | None) -> list[str]:
    low = (text or "").lower()
    return low.translate(_SPACED).split() if low.isascii() else WORD.findall(low)


class Terms:
    """Some terms, by kind and length of their first letters, so that a text's words are matched without making all their terms."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.words = frozenset(t for t in terms if not t.startswith("^"))
        firsts = [t[1:] for t in terms if t.startswith("^")]
        self.firsts = [(k, frozenset(f for f in firsts if len(f) == k)) for k in PREFIXES]

    def occurrences(self, counts: Counter) -> dict[str, int]:
        """How often each of the terms occurs, from the words' occurrences."""
        out = {w: counts[w] for w in counts.keys() & self.words}
        for w, n in counts.items():
            size = len(w)
            for k, firsts in self.firsts:
                if size <= k:
                    break
                if (f := w[:k]) in firsts:
                    out["^" + f] = out.get("^" + f, 0) + n
        return out


def weights(counts: Counter, terms: Terms | None = None) -> dict[str, float]:
    """1 + ln of the occurrences of each term, or of some, from the words' occurrences."""
    if terms is not None:
        n = terms.occurrences(counts)
    else:
        n = Counter()
        for w, k in counts.items():
            for t in terms_of(w):
                n[t] += k
    return {t: 1 + math.log(k) for t, k in n.items()}


def _weight(counts: Counter) -> float:
    """Weight of a document: that of its words."""
    return len(counts) + math.fsum(map(math.log, counts.values()))


def _sums(rows: DataFrame, only: Terms | None) -> DataFrame:
    """(term, fold, docs, weight) summed over rows (_fold, _text); the empty term stands for all words."""
    shared = rows.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared else None
        held: dict[tuple[str, int], list[float]] = {}

        def out() -> pa.RecordBatch:
            cols = [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.array([int(v[0]) for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.float64())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, ["term", "fold", "docs", "weight"])

        for b in batches:
            for fold, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts = Counter(words(text.as_py()))
                for t, w in (("", _weight(counts)), *weights(counts, known).items()):
                    x = held.setdefault((t, fold), [0, 0.0])
                    x[0] += 1
                    x[1] += w
                if len(held) > FLUSH:
                    yield out()
        if held:
            yield out()

    made = rows.select("_fold", "_text").mapInArrow(run, "term string, fold int, docs long, weight double")
    return made.groupBy("term").agg(
        F.sum("docs").alias("docs"),
        *[F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("weight"))), F.lit(0.0)).alias(f"w{k}") for k in range(FOLDS)],
    )


def corpus_shares(docs: DataFrame, terms: frozenset[str], text_col: str) -> dict[str, float]:
    """Each term's share of the weight of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(Terms(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total: dict[str, float] = {"": 0.0}
        for b in batches:
            for text in b.column(0):
                counts = Counter(words(text.as_py()))
                total[""] += _weight(counts)
                for t, w in weights(counts, known).items():
                    total[t] = total.get(t, 0.0) + w
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array(total.values(), pa.float64())], ["term", "weight"])

    sums = docs.select(F.col(text_col)).mapInArrow(run, "term string, weight double").groupBy("term").agg(F.sum("weight").alias("weight")).collect()
    by = {r.term: r.weight for r in sums}
    return {t: by.get(t, 0.0) / max(by.get("", 0.0), 1e-9) for t in terms}


def significance(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """-ln of the Chernoff bound on so much toxic weight by chance; 0 where a term isn't over-represented."""
    n = toxic + clean
    p = toxic / np.maximum(n, 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(p > 0, p * np.log(p / share), 0.0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - share)), 0.0)
    return np.where(p > share, n * far, 0.0)


def least_significance(found: np.ndarray, tested: int) -> float:
    """The bar of Benjamini and Hochberg at FALSE_RATE; infinite if none passes."""
    ranked = np.sort(found)[::-1]
    passes = np.flatnonzero(ranked >= np.log(max(tested, 1) / (FALSE_RATE * np.arange(1, len(ranked) + 1))))
    return float(ranked[passes[-1]]) if len(passes) else math.inf


def log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float, share: np.ndarray) -> np.ndarray:
    """Log-odds between the classes with a Dirichlet prior shaped like the corpus."""
    whole = PRIOR_SHARE * (all_toxic + all_clean)
    prior = whole * share
    odds = lambda y, n: np.log((y + prior) / np.maximum(n + whole - y - prior, 1e-9))
    return odds(toxic, all_toxic) - odds(clean, all_clean)


def segments(scores: list[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (first, last, score) of a sequence given by its positive places; other places score cost.

    The linear scan of Ruzzo and Tompa: a stack of candidates with the running sums before and after each."""
    stack: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    total, at = 0.0, -1
    for place, s in scores:
        total += cost * (place - at - 1)
        before, total, at = total, total + s, place
        first, low = place, before
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= low:
                k -= 1
            if k < 0 or stack[k][1] >= total:
                stack.append((low, total, first, place))
                break
            low, first = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, after - before) for before, after, a, b in stack]


def hits(found: list[str], model: Model) -> list[tuple[int, float]]:
    """Places and scores of the tokens that the model knows."""
    terms, heads, known = model.terms, model.heads, {}
    for w in {w for w in set(found) if w[: PREFIXES[0]] in heads}:
        best = max((terms[t][::-1] for t in terms_of(w) if t in terms), key=lambda x: x[0], default=None)
        if best:
            known[w] = best[1]
    return [(i, known[w]) for i, w in enumerate(found) if w in known] if known else []


def passages(text: str | None, model: Model) -> tuple[list[tuple[int, int, float]], int]:
    """Maximal segments in token places, and the number of tokens, one at least."""
    found = words(text)
    return segments(hits(found, model), model.gap), max(1, len(found))


def evidence(found: Iterable[float], n_tokens: int, constant: float) -> float:
    """-ln of the tail probability of the best sum of normalised segment scores, over any number of segments.

    A text has a segment's worth of chances at least, however short it is."""
    base = math.log1p(constant * n_tokens)
    total, most = 0.0, -base
    for r, s in enumerate(sorted(found, reverse=True), 1):
        total += s - base
        if r == 1:
            most = total
        elif total > r:
            most = max(most, total - (r - 1) * (math.log(total) + math.log(2)) + math.lgamma(r + 1) + math.lgamma(r))
    return most


def _curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic slope and offset for (evidence, label, rows), by Newton steps with a weak ridge, halved until they lessen the loss."""
    x = np.array([b[0] for b in bins], float)
    y, n = np.array([b[1] for b in bins], float), np.array([b[2] for b in bins], float)
    w = np.array([1.0, -2.0])
    design = np.stack([x, np.ones_like(x)], 1)
    loss = lambda w: float(np.sum(n * (np.logaddexp(0, design @ w) - y * (design @ w))) + 5e-3 * w @ w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        grad = design.T @ (n * (p - y)) + 1e-2 * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-9 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _loss(bins: list[tuple[float, int, int]], slope: float, offset: float) -> float:
    """-ln likelihood of (evidence, label, rows) under a curve."""
    return math.fsum(n * (float(np.logaddexp(0, slope * x + offset)) - y * (slope * x + offset)) for x, y, n in bins)


def _measured(sample: DataFrame, models: list[list[Model]]) -> DataFrame:
    """(label, n, hits, scores) of the sample's documents: for each of the lists, by its model of the document's fold."""
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for label, fold, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found, own, scores = words(text.as_py()), [], []
                for by_fold in shared.value:
                    own.append(hits(found, by_fold[fold]))
                    scores.append(sorted((s for _, _, s in segments(own[-1], by_fold[fold].gap)), reverse=True))
                rows.append((label, max(1, len(found)), [len(h) for h in own], scores))
            types = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["label", "n", "hits", "scores"])

    return sample.select("_label", "_fold", "_text").mapInArrow(run, "label int, n long, hits array<long>, scores array<array<double>>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model:
    """Terms, gap, constant and curve from the rows outside the held-out part."""
    sample = labelled_sample(docs, labels, label, MOD, HELD_OUT, TRAIN_DOCS, id_col, text_col)
    sample = sample.withColumn("_fold", F.pmod(F.xxhash64("_text"), F.lit(FOLDS)).cast("int"))
    sizes = {r._label: r["count"] for r in sample.groupBy("_label").count().collect()}
    n, ones = sum(sizes.values()), sum(k for y, k in sizes.items() if y)
    level = math.log((ones + 0.5) / (n - ones + 0.5))
    if not ones or ones == n:
        return Model(offset=level)
    toxic = _sums(sample.where("_label <> 0"), None).persist()
    tested = toxic.count() - 1
    rows = {r.term: r for r in toxic.where((F.col("docs") >= MIN_DOCS) | (F.col("term") == "")).collect()}
    toxic.unpersist()
    other = {r.term: r for r in _sums(sample.where("_label = 0"), Terms(frozenset(rows) - {""})).collect()}
    names = sorted(rows)  # "" first
    table = lambda by: np.array([[by[t][f"w{k}"] if t in by else 0.0 for k in range(FOLDS)] for t in names])
    t, c = table(rows), table(other)
    parts = [(t.sum(1), c.sum(1))] + [(t.sum(1) - t[:, k], c.sum(1) - c[:, k]) for k in range(FOLDS)]
    strong = [significance(a[1:], b[1:], a[0] / max(a[0] + b[0], 1e-9)) for a, b in parts]
    bar = least_significance(strong[0], tested)
    chosen = [np.flatnonzero(s >= bar) for s in strong]
    if not len(chosen[0]):
        return Model(offset=level)
    share = corpus_shares(docs, frozenset(names[1 + i] for i in np.unique(np.concatenate(chosen))), text_col)
    scored = []
    for (a, b), s, at in zip(parts, strong, chosen, strict=True):
        delta = log_odds(a[1:][at], b[1:][at], a[0], b[0], np.array([share[names[1 + i]] for i in at]))
        scored.append({names[1 + i]: (float(d), float(s[i])) for i, d in zip(at, delta, strict=True) if d > 0})
    models = [[Model({t: x for t, x in own.items() if x[0] >= bar}) for own in scored] for bar in BARS]
    for k, by_fold in enumerate(_gaps(_measured(sample, [m[1:] for m in models]))):
        for m in models[k]:
            m.gap = by_fold
    seen = cut(_measured(sample, [m[1:] for m in models]))
    clean = seen.where("label = 0")
    best = lambda k: F.coalesce(F.get(F.get("scores", F.lit(k)), F.lit(0)), F.lit(0.0))
    means = clean.agg(*[F.avg(F.col("n") * F.exp(-best(k))).alias(f"m{k}") for k in range(len(BARS))]).first()
    constants = [1 / max(m, 1e-9) for m in means]
    judge = F.udf(lambda scores, n: [evidence(s, n, c) for s, c in zip(scores, constants, strict=True)], "array<double>")
    each = seen.select((F.col("label") != 0).cast("int").alias("y"), F.posexplode(judge("scores", "n")).alias("bar", "e"))
    x = F.round(F.least(F.greatest("e", F.lit(LOW)), F.lit(HIGH)) / BIN) * BIN
    bins = sorted(each.groupBy("bar", x.alias("x"), "y").agg(F.count("*").alias("n")).collect())
    fits = []
    for k in range(len(BARS)):
        own = [(r.x, r.y, r.n) for r in bins if r.bar == k]
        curve = _curve(own)
        fits.append((_loss(own, *curve), k, curve))
    _, k, curve = min(fits)
    model = models[k][0]
    model.constant, (model.slope, model.offset) = constants[k], curve
    return model if model.terms else Model(offset=level)


def _gaps(measured: DataFrame) -> list[float]:
    """For each list of models the log-odds of a token that isn't in the model, from its share in the toxic documents with hits and in the clean ones."""
    hits = lambda k: F.get("hits", F.lit(k))
    cells = []
    for k in range(len(BARS)):
        toxic, clean = (F.col("label") != 0) & (hits(k) > 0), F.col("label") == 0
        cells += [F.sum(F.when(which, hits(k))) / F.sum(F.when(which, F.col("n"))) for which in (toxic, clean)]
    shares = measured.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()
    log = lambda share: math.log(max(1e-6, 1 - share))
    return [min(-1e-3, log(0.1 if t is None else t) - log(c or 0.0)) for t, c in zip(shares[::2], shares[1::2], strict=True)]


def probability(e: float, model: Model) -> float:
    return 1 / (1 + math.exp(-(min(max(e, LOW), HIGH) * model.slope + model.offset)))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs and the score in the column named by out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            found = (passages(t, m) for t in texts)
            yield pd.Series([probability(evidence((s for _, _, s in own), n, m.constant), m) for own, n in found], dtype="float64")

    return docs.withColumn(out, measure(F.col(text_col)) if model.terms else F.lit(probability(0.0, model)))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    model = fit(docs, labels)
    d = with_score(docs.select("doc_id", F.col("text").alias("_text")), model, "_text")
    return d.select("doc_id", (remainder("doc_id", MOD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic."""
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    kept = with_score(packed, fit(docs, labels), "_text", "_score").where(F.col("_score") < PREDICT_AT)
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
