"""From model outputs to labels: probabilities, counts, priority labels, tiers.

Predictions come as one column a label, a missing label as 0. Everything is a
projection: candidate labels are an array of structs whose natural order is the
priority, so no row is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.functions.taxonomy import BARGAINING_IDS, FINANCE, Taxonomy

COUNT_THRESHOLD = 0.45
LABEL_THRESHOLD = 0.35
RESOLVE_SHARE = 0.7


def sigmoid(x: Column, scale: float = 1.0, digits: int = 3) -> Column:
    """Logistic of scale * x, rounded; the exponent is clipped so that nothing overflows."""
    return F.round(1 / (1 + F.exp(-F.greatest(F.least(x.cast("double") * scale, F.lit(500.0)), F.lit(-500.0)))), digits)


def argmax_label(scores: Column) -> Column:
    """0-based place of the largest score, the first of ties; -1 for an empty or null array."""
    return F.coalesce(F.array_position(scores, F.array_max(scores)).cast("int") - 1, F.lit(-1))


def softmax_above(logits: Column, least: float = 0.5) -> Column:
    """0-based places whose softmax share exceeds least."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.filter(F.transform(logits, lambda x, i: F.when(F.exp(x - top) / total > least, i)), lambda i: i.isNotNull())


def from_maps(preds: DataFrame, column: str, tax: Taxonomy = FINANCE) -> DataFrame:
    """One row a prediction of a JSON array of maps: all columns but that one, n (1-based) and one column a label.

    Maps with the key "error" and unparseable JSON are left out; a missing label counts as 0."""
    parsed = F.from_json(column, "array<map<string,double>>")
    rows = preds.select(*[c for c in preds.columns if c != column], F.posexplode(parsed).alias("_i", "_m"))
    valid = rows.where("_m IS NOT NULL").where(~F.array_contains(F.map_keys("_m"), "error"))
    return valid.select(*[c for c in preds.columns if c != column], (F.col("_i") + 1).alias("n"), *[F.coalesce(F.col("_m")[k], F.lit(0.0)).alias(k) for k in tax.labels])


def binary(df: DataFrame, threshold: float = COUNT_THRESHOLD, tax: Taxonomy = FINANCE) -> DataFrame:
    """Each label column as 0 or 1."""
    return df.withColumns({k: (F.coalesce(F.col(k), F.lit(0.0)) >= threshold).cast("int") for k in tax.labels})


def label_counts(df: DataFrame, keys: list[str], threshold: float = COUNT_THRESHOLD, tax: Taxonomy = FINANCE) -> DataFrame:
    """Per report: how many of its predictions reach the threshold, by label, and their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_sentences"), *[F.count_if(F.coalesce(F.col(k), F.lit(0.0)) >= threshold).alias(f"n_{k}") for k in tax.labels])


def _best_specific(score: Callable[[str], str], threshold: float, tax: Taxonomy) -> str:
    """SQL for the specific type of the largest score, the first of ties, if it reaches its share of the threshold; else the generic type."""
    top = f"greatest({', '.join(map(score, tax.specific))})"
    whens = " ".join(f"WHEN {score(t)} = {top} THEN '{t}'" for t in tax.specific)
    return f"CASE WHEN {top} < {threshold * RESOLVE_SHARE}D OR {top} <= 0 THEN '{tax.generic}' {whens} ELSE '{tax.generic}' END"


def _candidates_sql(tax: Taxonomy, threshold: float, per_type: bool) -> str:
    """SQL for the candidates, from the columns _by_use and _by_context. One text is built, not a tree of calls: they are a hundred conditions."""
    p = lambda k: f"coalesce(`{k}`, 0.0D)"
    on = lambda k: f"{p(k)} >= {threshold}D"
    none = lambda keys: " AND ".join(f"{p(k)} < {threshold}D" for k in keys)
    no_use, no_time = none(f"{t}_use" for t in tax.types), none(tax.times)
    now, spec = tax.times[0], tax.times[-1]

    def chosen(t: str, resolved: str, value: Callable[[str], object]) -> str:
        """A constant of the type that t resolves to."""
        if t != tax.generic:
            return str(value(t))
        return f"CASE {resolved} " + " ".join(f"WHEN '{s}' THEN {value(s)}" for s in tax.specific) + f" ELSE {value(t)} END"

    found: list[str] = []

    def add(condition: str, rank: str, score: str, label: str) -> None:
        found.append(f"CASE WHEN {condition} THEN named_struct('rank', CAST({rank} AS DOUBLE), 'minus', -({score}), 'order', {len(found)}, 'id', {label}) END")

    for t in tax.types:
        use = f"{t}_use"
        penalty = chosen(t, "_by_use", lambda s: f"{float(tax.penalised.get(s, 0.0))}D") if per_type else "0.0D"
        for k, time in enumerate(tax.times):
            label = chosen(t, "_by_use", lambda s, k=k: tax.usage_ids[s][k])
            add(f"{on(use)} AND {on(time)}", f"{1 + k} + {penalty}" if time == spec else str(1 + k), f"{p(use)} * {p(time)}", label)
            if per_type:
                add(f"{none([use])} AND {on(t)} AND {on(time)}", f"{6 if time == spec else 5} + {penalty}", f"{p(t)} * {p(time)}", label)
            elif time != spec:  # with spec active a context-only mention isn't ranked here
                add(f"{no_use} AND {none([spec])} AND {on(t)} AND {on(time)}", "5", f"{p(t)} * {p(time)}", label)
        add(f"{on(use)} AND {no_time}", f"1.5D + {penalty}", p(use), chosen(t, "_by_use", lambda s: tax.usage_ids[s][0]))
    for x in tax.extras:
        add(f"{on(x)} AND {on(now)}", "4", f"{p(x)} * {p(now)}", str(tax.extra_ids[x][0]))
        add(f"{on(x)} AND {none([now])}", "7", p(x), str(tax.extra_ids[x][1]))
    for t in tax.types:
        rank = chosen(t, "_by_context", lambda s: f"{8.0 + float(tax.penalised.get(s, 0.0))}D")
        add(f"{no_use} AND {on(t)}", rank, p(t), chosen(t, "_by_context", lambda s: tax.context_ids[s]))
    add(on(tax.irrelevant), "9", p(tax.irrelevant), str(tax.irrelevant_id))
    return f"array_sort(array_compact(array({', '.join(found)})))"


def resolve(df: DataFrame, tax: Taxonomy = FINANCE, threshold: float = LABEL_THRESHOLD, per_type: bool = False) -> DataFrame:
    """df with label_ids and label_scores (arrays, best first, each id once), primary_id, primary_score and tier.

    Candidates are structs of (rank, -score, order, id), whose natural order is the priority. per_type, as notebooks rank: a type's context
    counts beside other types' use, speculative context has a rank of its own, and penalties of the resolved type hold for
    use without a time, speculative use and context with a time, too."""
    p = lambda k: f"coalesce(`{k}`, 0.0D)"
    by_use = _best_specific(lambda t: f"{p(t)} + {p(f'{t}_use')}", threshold, tax)
    by_context = _best_specific(p, threshold, tax)
    d = df.selectExpr("*", f"{by_use} AS _by_use", f"{by_context} AS _by_context")
    d = d.selectExpr(*[f"`{c}`" for c in df.columns], f"{_candidates_sql(tax, threshold, per_type)} AS _all")
    d = d.selectExpr(*[f"`{c}`" for c in df.columns], "filter(_all, (x, i) -> array_position(transform(_all, y -> y.id), x.id) = i + 1) AS _own")
    ids = f"CASE WHEN size(_own) = 0 THEN array({tax.irrelevant_id}) ELSE transform(_own, x -> x.id) END AS label_ids"
    scores = "CASE WHEN size(_own) = 0 THEN array(0.0D) ELSE transform(_own, x -> -x.minus) END AS label_scores"
    d = d.selectExpr(*[f"`{c}`" for c in df.columns], ids, scores)
    d = d.selectExpr("*", "element_at(label_ids, 1) AS primary_id", "element_at(label_scores, 1) AS primary_score")
    return d.withColumn("tier", tier(F.col("primary_score")))


def tier(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def name_of(label_id: Column, tax: Taxonomy = FINANCE) -> Column:
    """The name of an id, "Unknown" for one that the taxonomy lacks."""
    names = ", ".join(f"{i}, '{name}'" for i, name in tax.names.items())
    return F.coalesce(F.expr(f"map({names})")[label_id], F.lit("Unknown"))


def category_of(name: Column) -> Column:
    """The part of a label's name before its time, in one word."""
    return F.replace(F.split_part(name, F.lit(" ("), F.lit(1)), F.lit(" "), F.lit("_"))


def multi_hot_primary(tax: Taxonomy = FINANCE) -> Column:
    """The id of a multi-hot row: extras before usage, usage by type then time (the first time where none is set), then speculation, context, irrelevance."""
    on = lambda k: F.coalesce(F.col(k), F.lit(0)) > 0
    rules: list[tuple[Column, int]] = []
    for x in tax.extras:
        rules += [(on(x) & on(tax.times[1]), tax.extra_ids[x][1]), (on(x), tax.extra_ids[x][0])]
    for t in tax.types:
        rules += [(on(f"{t}_use") & on(time), tax.usage_ids[t][k]) for k, time in enumerate(tax.times)]
        rules.append((on(f"{t}_use"), tax.usage_ids[t][0]))
    rules += [(on(t) & on(tax.times[-1]), tax.usage_ids[t][-1]) for t in tax.types]
    rules += [(on(t), tax.context_ids[t]) for t in tax.types]
    return _first(rules, tax.irrelevant_id)


def bargaining_primary() -> Column:
    """The id of a collective-bargaining row: one-sided geography, then coverage, risk and explicit absence."""
    on = lambda k: F.coalesce(F.col(k), F.lit(0)) > 0
    ids = BARGAINING_IDS
    here, abroad = on("cb_us"), on("cb_international")
    rules = [(here & ~abroad, ids["cb_us"]), (abroad & ~here, ids["cb_international"])]
    rules += [(on(k), ids[k]) for k in ("cb_coverage", "cb_risk", "no_cb")]
    return _first(rules, ids["irrelevant"])


def _first(rules: list[tuple[Column, int]], otherwise: int) -> Column:
    out = F.lit(otherwise)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out
