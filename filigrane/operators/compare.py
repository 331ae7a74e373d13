"""Model flags against the keyword baseline: confusion counts, metrics, classes and deltas.

Every summary over several categories is one pass: conditional sums for all of
them at once, then one unpivot of a single row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Comparison:
    name: str
    truth: str
    guess: str

    @property
    def slug(self) -> str:
        return self.name.lower().replace(" ", "_").replace("(", "").replace(")", "").replace("/", "_")


COMPARISONS = (
    Comparison("IR", "ir_user", "model_ir_user"),
    Comparison("FX", "fx_user", "model_fx_user"),
    Comparison("CP", "cp_user", "model_cp_user"),
    Comparison("Hedges (IR/FX/CP)", "user", "model_user"),
    Comparison("All", "user", "model_user_all"),
)


def merge(model: DataFrame, keyword: DataFrame, keys: tuple[str, ...] = ("cik", "year"), how: str = "inner") -> DataFrame:
    """Both sides on their keys; flags that one side lacks are 0."""
    joined = model.join(keyword, list(keys), how)
    flags = [c for c, t in joined.dtypes if c not in keys and t in ("int", "bigint", "double", "smallint", "tinyint")]
    return joined.na.fill(0, flags)


def _share(top: Column, bottom: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0)) * 100, 2)


def confusion(df: DataFrame, comparisons: tuple[Comparison, ...] = COMPARISONS) -> DataFrame:
    """(category, tp, fp, tn, fn, total) for each comparison."""
    parts = []
    for c in comparisons:
        t, g = F.col(c.truth) == 1, F.col(c.guess) == 1
        parts.append(F.struct(F.lit(c.name).alias("category"), *[F.count_if(x).alias(k) for k, x in (("tp", t & g), ("fp", ~t & g), ("tn", ~t & ~g), ("fn", t & ~g))]))
    one = df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    return one.withColumn("total", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))


def metrics(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 in percent, two decimals, 0 where a denominator is 0; agreement_rate equals accuracy."""
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    return counts.select("*", _share(tp + tn, F.col("total")).alias("accuracy"), _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def detailed(df: DataFrame, comparisons: tuple[Comparison, ...] = COMPARISONS) -> DataFrame:
    """agree_<name> (0 agree, 1 model only, -1 keyword only) and class_<name> for each comparison."""
    made = {}
    for c in comparisons:
        t, g = F.col(c.truth) == 1, F.col(c.guess) == 1
        made[f"agree_{c.slug}"] = F.when(t == g, 0).when(g, 1).otherwise(-1)
        made[f"class_{c.slug}"] = F.when(t & g, "True Positive").when(~t & ~g, "True Negative").when(g, "False Positive").otherwise("False Negative")
    return df.withColumns(made)


def cross_tab(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts by keyword and model flag with margins named All; classes that don't occur have no row."""
    label = lambda c, yes, no: F.when(F.grouping(c) == 1, "All").when(F.col(c) == 1, yes).otherwise(no)
    cube = df.cube(truth, guess).agg(F.count("*").alias("n"), label(truth, "Keyword_Yes", "Keyword_No").alias("keyword"), label(guess, "Model_Yes", "Model_No").alias("model"))
    return cube.select("keyword", "model", "n")


def model_only(df: DataFrame, truth: str = "user", guess: str = "model_user_all") -> DataFrame:
    return df.where((F.col(truth) == 0) & (F.col(guess) == 1))


def positive_stats(df: DataFrame, flags: list[str]) -> DataFrame:
    """(flag, positive, negative, total, rate) for each flag."""
    parts = [F.struct(F.lit(k).alias("flag"), F.count_if(F.col(k) == 1).alias("positive"), F.count_if(F.col(k) != 1).alias("negative"), F.count("*").alias("total")) for k in flags]
    one = df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    return one.withColumn("rate", _share(F.col("positive"), F.col("total")))


def translation(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """How many of those who speculate also use: (category, speculative, actual, not_actual, rate). pairs: name → (speculative flag, actual flag)."""
    parts = []
    for name, (spec, actual) in pairs.items():
        s, a = F.col(spec) == 1, F.col(actual) == 1
        parts.append(F.struct(F.lit(name).alias("category"), F.count_if(s).alias("speculative"), F.count_if(s & a).alias("actual"), F.count_if(s & ~a).alias("not_actual")))
    one = df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    return one.withColumn("rate", _share(F.col("actual"), F.col("speculative")))


def keyword_against_speculation(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(category, keyword_only, both, spec_only, neither). pairs: name → (keyword flag, speculative flag)."""
    parts = []
    for name, (keyword, spec) in pairs.items():
        k, s = F.col(keyword) == 1, F.col(spec) == 1
        parts.append(F.struct(F.lit(name).alias("category"), *[F.count_if(x).alias(c) for c, x in (("keyword_only", k & ~s), ("both", k & s), ("spec_only", ~k & s), ("neither", ~k & ~s))]))
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def spec_to_actual(spec: str, actual: str) -> Column:
    """Class of a row by speculation and use."""
    s, a = F.col(spec) == 1, F.col(actual) == 1
    return F.when(s & a, "Spec->Actual").when(s, "Spec->NoActual").when(a, "NoSpec->Actual").otherwise("NoSpec->NoActual")


def agreements(df: DataFrame, variants: dict[str, dict[str, tuple[str, str]]]) -> DataFrame:
    """One row a row and variant: variant, 0/1 flags <name>_agree of each pair of flags, and the class of the pair named overall."""
    made = []
    for name, pairs in variants.items():
        t, g = (F.col(c) == 1 for c in pairs["overall"])
        verdict = F.when(t & g, "True Positive").when(~t & ~g, "True Negative").when(g, "False Positive").otherwise("False Negative")
        made.append(F.struct(F.lit(name).alias("variant"), *[(F.col(a) == F.col(b)).cast("int").alias(f"{k}_agree") for k, (a, b) in pairs.items()], verdict.alias("overall_classification")))
    used = {c for pairs in variants.values() for pair in pairs.values() for c in pair}
    return df.select(*[c for c in df.columns if c not in used], F.explode(F.array(*made)).alias("x")).select("*", "x.*").drop("x")


def improvements(df: DataFrame, measures: dict[str, tuple[str | None, str, str, str]]) -> DataFrame:
    """(metric, current_only, current_historic, improvement), all measures in one pass.

    measures: name → (keyword flag or none, current flag, current and historic flag, measure); a measure is accuracy, precision, recall, f1 or positive_rate."""

    def value(truth: str | None, guess: str, measure: str) -> Column:
        g = F.col(guess) == 1
        if measure == "positive_rate":
            return _share(F.count_if(g), F.count(F.lit(1)))
        t = F.col(truth) == 1
        tp, fp, tn, fn = (F.count_if(x) for x in (t & g, ~t & g, ~t & ~g, t & ~g))
        top, bottom = {"accuracy": (tp + tn, tp + fp + tn + fn), "precision": (tp, tp + fp), "recall": (tp, tp + fn), "f1": (2 * tp, 2 * tp + fp + fn)}[measure]
        return _share(top, bottom)

    cells = [F.struct(F.lit(name).alias("metric"), value(t, now, m).alias("current_only"), value(t, ever, m).alias("current_historic")) for name, (t, now, ever, m) in measures.items()]
    rows = df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    return rows.withColumn("improvement", F.round(F.col("current_historic") - F.col("current_only"), 2))


def refreshed(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys in which other's columns replace those of the same name."""
    return rows.drop(*[c for c in other.columns if c not in keys]).join(other, keys, "left")


def looked_up(rows: DataFrame, other: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each row with the first of its matches by order, as a scan of the other table would find it; null columns without one."""
    rest = [c for c in other.columns if c not in keys]
    first = other.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return rows.join(first, keys, "left").select("*", *[F.col("_first")[c].alias(c) for c in rest]).drop("_first")


def renamed_flags(keyword: DataFrame) -> DataFrame:
    """Keyword flags by what they say: user → keyword_user, <type>_user → keyword_<type>."""
    return keyword.withColumnsRenamed({c: "keyword_user" if c == "user" else f"keyword_{c.removesuffix('_user')}" for c in keyword.columns if c == "user" or c.endswith("_user")})


def delta(before: DataFrame, after: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Both summaries side by side and what each measure gained."""
    a = before.select(key, *[F.col(m).alias(f"{m}_before") for m in measures])
    b = after.select(key, *[F.col(m).alias(f"{m}_after") for m in measures])
    return a.join(b, key).select(key, *[c for m in measures for c in (f"{m}_before", f"{m}_after", F.round(F.col(f"{m}_after") - F.col(f"{m}_before"), 2).alias(f"{m}_gain"))])


def metrics_union(summaries: dict[str, DataFrame]) -> DataFrame:
    """Summaries one below the other with the name of each; a category loses what follows in brackets."""
    parts = [d.withColumn("file", F.lit(name)) for name, d in summaries.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("category", F.trim(F.regexp_replace("category", r"\s*\(.*\)", "")))


def multi_label_scores(df: DataFrame, labels: list[str], threshold: float = 0.5) -> DataFrame:
    """Micro F1, share of rows with every label right, and label accuracy of <label>_truth against <label>_score."""
    t = {k: F.col(f"{k}_truth") >= threshold for k in labels}
    g = {k: F.col(f"{k}_score") >= threshold for k in labels}
    count = lambda f: sum((F.sum(f(k).cast("int")) for k in labels), F.lit(0))
    exact = F.lit(True)
    for k in labels:
        exact = exact & (t[k] == g[k])
    one = df.agg(count(lambda k: t[k] & g[k]).alias("tp"), count(lambda k: ~t[k] & g[k]).alias("fp"), count(lambda k: t[k] & ~g[k]).alias("fn"), F.count_if(exact).alias("exact"), F.count("*").alias("rows"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.select("tp", "fp", "fn", _share(2 * tp, 2 * tp + fp + fn).alias("f1_micro"), _share(F.col("exact"), F.col("rows")).alias("exact_match"))


AUC_PARTS = 64


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by ranks with ties averaged.

    Scores are counted by value, and the values dealt to AUC_PARTS ranges of about equal size: each range is ranked by
    itself, from the rows below it, so no task holds all values."""
    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("n"))
    edges = sorted(set(by.approxQuantile("s", [i / AUC_PARTS for i in range(1, AUC_PARTS)], 0.005)))
    part = sum(((F.col("s") > e).cast("int") for e in edges), F.lit(0))
    parted = by.withColumn("part", part)
    sums = parted.groupBy("part").agg(F.sum("n").alias("m"))
    before = sums.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # AUC_PARTS rows
    own = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = parted.withColumn("below", own).join(F.broadcast(before), "part")
    won = ranked.select("p", "n", (F.col("p") * (F.col("before") + F.col("below") + F.col("n") / 2)).alias("won"))
    return won.agg(F.round(F.try_divide(F.sum("won"), F.sum("p") * F.sum("n")), 6).alias("auc"))


def weighted_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 over classes, weighted by their true rows."""
    pairs = df.groupBy(truth, guess).agg(F.count("*").alias("n"))
    each = pairs.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("g"), F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0).alias("h")), F.struct(F.col(guess).alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("g"), F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    by = each.groupBy("c").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = ratio(F.col("h"), F.col("g")), ratio(F.col("h"), F.col("t"))
    f1 = ratio(2 * F.col("h"), F.col("t") + F.col("g"))
    weighted = lambda x: F.round(F.sum(x * F.col("t")) / F.sum("t"), 4)
    return by.agg(weighted(p).alias("precision"), weighted(r).alias("recall"), weighted(f1).alias("f1"))
