"""Synthetic training corpora: a plan of rows, template products, and seeded paragraphs.

Plans and products are tables; a paragraph is a function of its row's seed
alone, so any partitioning and any retry give the same corpus.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.functions.taxonomy import BARGAINING_LABELS, FINANCE, Taxonomy
from filigrane.plans import templates as T

def draw(*keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) / 1_000_003


def hedge_plan(spark: SparkSession, n: int, tax: Taxonomy = FINANCE) -> DataFrame:
    """(kind, type, time, rows): how many rows of each kind a corpus of n a label takes. c = n / 5 rows a unit."""
    c = n // 5
    rows = []
    for t in tax.types:
        rows += [("hedge", t, "curr", 3 * c), ("hedge", t, "hist", 3 * c), ("hedge", t, "spec", c // 2)]
    rows.append(("hedge", "any", "spec", c // 2))
    rows += [(x, x, time, c * 3) for x in tax.extras for time in ("curr", "hist")]
    rows += [("noise", f"topic{i}", "none", 2 * c) for i in range(6)]
    rows += [("noise", "random", "none", n), ("noise", "filing", "none", n // 2)]
    return spark.createDataFrame(rows, "kind string, type string, time string, rows int")


def legacy_plan(spark: SparkSession, n: int) -> DataFrame:
    """The older plan: four types by 3, 3 and 1 units, liability classes 3 to 7 by half a unit, and twice n rows of noise."""
    c = n // 5
    rows = [("old_hedge", t, time, k * c) for t in ("ir", "fx", "cp", "gen") for time, k in (("curr", 3), ("hist", 3), ("spec", 1))]
    rows += [("liability", str(i), "none", c // 2) for i in range(3, 8)] + [("old_noise", "random", "none", 2 * n)]
    return spark.createDataFrame(rows, "kind string, type string, time string, rows int")


def bargaining_plan(spark: SparkSession, n: int) -> DataFrame:
    """Coverage three units, its absence two, the rest one."""
    weight = {"coverage": 3, "no_coverage": 2}
    return spark.createDataFrame([("bargaining", k, "none", n * weight.get(k, 1)) for k in BARGAINING_TYPES], "kind string, type string, time string, rows int")


def seeds(plan: DataFrame, seed: int = 42) -> DataFrame:
    """One row for each row that the plan asks for, with a seed of its own."""
    rows = plan.where("rows > 0").select("kind", "type", "time", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("n"))
    return rows.withColumn("seed", F.xxhash64(F.lit(seed), "kind", "type", "time", "n"))


def product(spark: SparkSession, template: str, values: dict[str, list[str]]) -> DataFrame:
    """Every filling of a template's placeholders, as sentences. The lists are written by hand, so their product is small."""
    names = [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", template)) if n in values]
    text: Column = F.lit(template)
    out = spark.range(1)
    for name in names:
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values[name]])).alias(name))
    for name in names:
        text = F.replace(text, F.lit("{" + name + "}"), F.col(name))
    return out.select(*names, text.alias("sentence"))


def with_prefixes(terms: DataFrame, prefixes: list[str], share: float = 0.15) -> DataFrame:
    """Terms, and for a hash-drawn share of the pairs a prefixed form."""
    pairs = terms.select("term", F.explode(F.array(*[F.lit(p) for p in prefixes])).alias("p")).where(draw(F.col("term"), F.col("p")) < share)
    return terms.select("term").union(pairs.select(F.concat_ws(" ", "p", "term").alias("term"))).distinct()


def amount(rng: random.Random) -> str:
    """A tenth are nil; half of the others are scaled up."""
    if rng.random() < 0.1:
        return "0"
    value = rng.randint(1, 999)
    return f"{value * rng.choice((10, 100)) if rng.random() < 0.5 else value:,}"


BARGAINING_TYPES = ("coverage", "no_coverage", "risk", "international", "us_only", "adversarial", "irrelevant")
OLD_LABELS = ("deriv", "ir", "fx", "cp", "equity", "embed", "curr", "hist", "spec", "debt_ctx", "fx_ctx", "eq_ctx", "comm_ctx", "emb_ctx", "spec_ctx", "gen_ctx", "irrelevant")  # fixed values
PASSES = 3


def position_templates(spark: SparkSession, type_: str, time: str) -> DataFrame:
    """Every position sentence of a type: lead, figures and, but for speculation, a connected earlier figure and a result."""
    leads, results = list(T.POSITIONS[time]), [*T.RESULTS["gen"], *(T.RESULTS[type_] if type_ != "gen" else ())]
    out = spark.createDataFrame([(p,) for p in leads], "lead string").withColumn("type", F.lit(type_))
    if time == "spec":
        return out.select("type", F.concat("lead", F.lit(".")).alias("template"))
    pick = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    out = out.select("*", pick("figure", T.FIGURES)).select("*", pick("connector", T.CONNECTORS)).select("*", pick("result", results))
    lead = F.replace(F.col("lead"), F.lit("{figure}"), F.col("figure"))
    return out.select("type", F.concat_ws(" ", lead, F.col("connector"), F.concat(F.lit("${amount2} million a year before; "), "result", F.lit("."))).alias("template"))


def mitigation_templates(spark: SparkSession, type_: str) -> DataFrame:
    """Every sentence that names an instrument and what it is for."""
    return product(spark, "{company} uses {instrument} {aim}.", {"instrument": list(T.INSTRUMENTS), "aim": [m.replace("{subject}", T.SUBJECTS[type_]) for m in T.MITIGATIONS]}).select(F.lit(type_).alias("type"), F.col("sentence").alias("template"))


def context_templates(spark: SparkSession, type_: str) -> DataFrame:
    """Every exposure sentence of a type, by itself and before a risk sentence."""
    tails = ["", " This risk is monitored.", " No instrument is used against it."]
    rows = [(type_, e + t) for e in T.EXPOSURES[type_] for t in tails]
    return spark.createDataFrame(rows, "type string, template string")


def fillings(rng: random.Random, type_: str, geography: str = "generic") -> dict[str, str]:
    """A value for every placeholder, the same all over a paragraph."""
    year = rng.randint(1995, 2024)
    return {
        "company": rng.choice(T.COMPANIES), "name": rng.choice(T.NAMES), "instrument": f"{T.SUBJECTS.get(type_, 'market')} {rng.choice(T.INSTRUMENTS)}", "figure": rng.choice(T.FIGURES),
        "commodity": rng.choice(T.COMMODITIES), "currency": rng.choice(T.CURRENCIES), "subject": T.SUBJECTS.get(type_, "market"), "month": rng.choice(T.MONTHS), "day": str(rng.randint(28, 30)),
        "year": str(year), "earlier": str(year - rng.randint(1, 5)), "later": str(year + rng.randint(1, 8)), "quarter": rng.choice(("quarter", "half year")), "amount2": amount(rng), "amount": amount(rng),
        "share": str(rng.randint(2, 95)), "count": f"{rng.randint(10, 9000):,}", "few": str(rng.randint(2, 12)), "price": f"{rng.uniform(1, 40):.2f}", "file": f"{rng.randint(1, 99999):05}",
        "where": rng.choice(T.PLACES[geography]), "union": rng.choice(T.UNIONS[geography]),
    }


def filled(text: str, values: dict[str, str]) -> str:
    """Placeholders replaced in PASSES passes, as values may name others; what is unknown is an error."""
    for _ in range(PASSES):
        text = re.sub(r"\{(\w+)\}", lambda m: values[m[1]], text)
    if "{" in text:
        raise ValueError(f"placeholders are left in {text!r}")
    return text


def _hedge(rng: random.Random, type_: str, time: str) -> tuple[list[str], dict[str, int]]:
    """Exposure, position, aim, expiry, payment and policy sentences of a type in a time."""
    parts, labels = [], {type_: 1, time: 1}
    if rng.random() < 0.5:
        parts.append(rng.choice(T.EXPOSURES[type_]))
    position = rng.choice(T.POSITIONS[time])
    parts.append(f"{position} {rng.choice(T.MITIGATIONS)}." if rng.random() < 0.4 else f"{position}.")
    if time != "spec":
        labels[f"{type_}_use"] = 1
        parts += [rng.choice(T.EXPIRIES[time])] * (rng.random() < 0.4)
        parts += [rng.choice(T.PAYMENTS)] * (rng.random() < 0.3)
    parts += [rng.choice(T.POLICIES)] * (time == "spec" or rng.random() < 0.35)
    parts += [rng.choice(T.POLICY_UPDATES)] * (rng.random() < 0.15)
    return parts, labels


def _noise(rng: random.Random, type_: str) -> list[str]:
    if type_ == "filing":
        return rng.sample(T.FILING, rng.randint(2, 4))
    pool = T.TOPICS.get(type_) or (*T.ACCOUNTING, *(s for topic in T.TOPICS.values() for s in topic))
    return rng.sample(pool, rng.randint(1, min(3, len(pool))))


def _bargaining(rng: random.Random, type_: str) -> tuple[str, dict[str, int], str]:
    """Two to four sentences; geography counts as a label where the text names a place or a union of it."""
    geography = {"us_only": "us", "international": "international"}.get(type_) or rng.choice(("us", "international", "generic"))
    labels = dict.fromkeys(BARGAINING_LABELS, 0)
    own = {"coverage": "cb_coverage", "us_only": "cb_coverage", "international": "cb_coverage", "no_coverage": "no_cb", "adversarial": "no_cb", "risk": "cb_risk", "irrelevant": "irrelevant"}[type_]
    labels[own] = 1
    if type_ == "risk" and geography != "generic":
        labels["us_risk" if geography == "us" else "int_risk"] = 1
    more = {"coverage": ("relations", "expiry", "talks"), "us_only": ("relations", "expiry", "talks"), "international": ("relations", "expiry", "talks"), "no_coverage": ("relations", "risk"), "risk": ("risk",), "adversarial": ("no_coverage", "relations"), "irrelevant": ("irrelevant",)}[type_]
    means = {"expiry": "cb_coverage", "talks": "cb_coverage", "risk": "cb_risk", "no_coverage": "no_cb"}
    parts = [rng.choice(T.BARGAINING[type_])]
    for pool in rng.choices(more, k=rng.randint(1, 3)):
        if (sentence := rng.choice(T.BARGAINING[pool])) not in parts:
            parts.append(sentence)
            if pool in means:
                labels[means[pool]] = 1
    rng.shuffle(parts)
    text = ". ".join(parts) + "."
    if geography != "generic" and ("{where}" in text or "{union}" in text):
        labels["cb_us" if geography == "us" else "cb_international"] = 1
    return (rng.choice(INTRO) if rng.random() < 0.15 else "") + text, labels, geography


INTRO = T.INTROS


def _old(rng: random.Random, kind: str, type_: str, time: str) -> tuple[list[str], dict[str, int], str]:
    """Paragraphs of the older plan with its 17 labels: hedges that mix up to three types, liabilities and embedded derivatives by class, accounting and filing noise."""
    labels = dict.fromkeys(OLD_LABELS, 0)
    names, contexts = {"ir": "ir", "fx": "fx", "cp": "cp", "eq": "equity"}, {"ir": "debt_ctx", "fx": "fx_ctx", "cp": "comm_ctx", "eq": "eq_ctx", "gen": "gen_ctx"}
    if kind == "old_hedge":
        types = [type_, *rng.sample([t for t in names if t != type_], rng.choice((0, 0, 1, 2)))] if type_ != "gen" else [type_]
        parts = []
        for t in types:
            own, _ = _hedge(rng, t, time)
            parts += own
            labels |= {names[t]: 1} if t in names else {}
            labels[contexts[t]] |= int(any(s in T.EXPOSURES[t] for s in own))
        labels |= {"deriv": 1, time: 1} | ({"spec_ctx": 1} if time == "spec" else {})
        return parts, labels, type_
    cls = int(type_)
    if cls == 3:
        labels["irrelevant"] = 1
        return (rng.sample(T.FILING, 3) if rng.random() < 0.3 else rng.sample(T.ACCOUNTING, 2)), labels, "gen"
    extra, when = ("warr" if cls in (4, 5) else "emb"), ("curr" if cls in (4, 6) else "hist")
    labels |= {"deriv": 1, when: 1} | ({"embed": 1, "emb_ctx": 1} if extra == "emb" else {})
    return rng.sample(T.EXTRAS[extra][when], rng.randint(1, 2)), labels, "gen"


def paragraph(kind: str, type_: str, time: str, seed: int, tax: Taxonomy = FINANCE) -> tuple[str, dict[str, int]]:
    """A paragraph and its multi-hot labels from a row of a plan; an unknown kind is an error."""
    rng = random.Random(seed)
    if kind == "bargaining":
        text, labels, geography = _bargaining(rng, type_)
        return tidy(filled(text, fillings(rng, "gen", geography))), labels
    if kind in ("old_hedge", "liability"):
        parts, labels, subject = _old(rng, kind, type_, time)
        return tidy(filled(" ".join(parts), fillings(rng, subject))), labels
    if kind == "old_noise":
        return tidy(filled(" ".join(_noise(rng, type_)), fillings(rng, "gen"))), dict.fromkeys(OLD_LABELS, 0) | {"irrelevant": 1}
    labels = dict.fromkeys(tax.labels, 0)
    subject = "gen"
    if kind == "hedge":
        subject = rng.choice(tax.types) if type_ == "any" else type_
        parts, own = _hedge(rng, subject, time)
        labels |= own
    elif kind in tax.extras:
        parts = rng.sample(T.EXTRAS[kind][time], rng.randint(1, 2))
        labels |= {kind: 1, time: 1, tax.generic: 1}
    elif kind == "noise":
        parts = _noise(rng, type_)
        labels[tax.irrelevant] = 1
    else:
        raise ValueError(f"no paragraph is known for {kind}")
    return tidy(filled(" ".join(parts), fillings(rng, subject)), rng), labels


def tidy(text: str, rng: random.Random | None = None) -> str:
    """Double spaces and stops, and clumsy forms, put right; sentences begin in upper case. With rng, some nil amounts and notional figures go."""
    for clumsy, better in ((r"\bWe's\b", "Our"), (r"\b([Ww])e is\b", r"\1e are"), (r"\b([Ww])e has\b", r"\1e have"), (r"\b([Ww])e (uses|buys|holds|pays)\b", lambda m: f"{m[1]}e {m[2][:-1]}"), (r"\bOur subsidiaries (is|has)\b", lambda m: "Our subsidiaries " + {"is": "are", "has": "have"}[m[1]])):
        text = re.sub(clumsy, better, text)
    if rng:
        text = re.sub(r"\$0 million", "nil" if rng.random() < 0.5 else "$0 million", text)
        if rng.random() < 0.1:
            text = re.sub(r", with (?:a )?notional amounts? of [^.]*?(?=\.(?:\s|$)| to )", "", text)
    text = re.sub(r"(?<!\.)\.{2}(?!\.)", ".", re.sub(r"\s{2,}", " ", text)).strip()
    return re.sub(r"(^|[.!?]\s+)([a-z])", lambda m: m[1] + m[2].upper(), text)


def corpus(rows: DataFrame) -> DataFrame:
    """seeds() → (sentence, labels as JSON)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [paragraph(*r) for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([json.dumps(m[1]) for m in made], pa.string())], ["sentence", "labels"])

    return rows.select("kind", "type", "time", "seed").mapInArrow(run, "sentence string, labels string")
