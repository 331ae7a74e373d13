"""Queries of the older reviews: agreement flags, gains, groups, inspected sentences and notebook labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from filigrane.functions.taxonomy import NOTEBOOK
from filigrane.operators import compare, labels, matrix, report
from filigrane.operators.labels import LABEL_THRESHOLD
from filigrane.plans import demo
from filigrane.plans.catalog import _TOP_SQL, PRIMARY, active_sql, names_sql, primary_sql, query
from filigrane.plans.demo import BASE, KEYWORD, LABELS, MODEL_COLUMNS, PRED, table

TYPES = ("ir", "fx", "cp")
_NOW = {t: f"{t}_use >= 0.45 AND curr >= 0.45" for t in (*TYPES, "eq", "gen")} | {x: f"{x} >= 0.45 AND curr >= 0.45" for x in ("warr", "emb")}
_EVER = {k: v.replace("curr >= 0.45", "(curr >= 0.45 OR hist >= 0.45)") for k, v in _NOW.items()}
_KINDS = (("current", _NOW), ("all", _EVER))


def _any(on: dict[str, str], names) -> str:
    return " OR ".join(f"({on[k]})" for k in names)


_FLAG_RULES = {
    **{f"model_{t}_{kind}": on[t] for kind, on in _KINDS for t in TYPES},
    **{f"model_user_{kind}": _any(on, TYPES) for kind, on in _KINDS},
    **{f"model_any_deriv_{kind}": _any(on, on) for kind, on in _KINDS},
    **{f"model_liab_{kind}": on["warr"] for kind, on in _KINDS},
    **{f"model_embed_{kind}": on["emb"] for kind, on in _KINDS},
}
_RENAMED = """keyword_x AS (SELECT cik, year, "user" AS keyword_user, ir_user AS keyword_ir, fx_user AS keyword_fx, cp_user AS keyword_cp FROM keyword)"""
_FLAGS_SQL = "WITH " + f"{PRED}, {KEYWORD}, {_RENAMED}, m AS (SELECT cik, year, " + ", ".join(f"max(CASE WHEN {rule} THEN 1 ELSE 0 END) AS {k}" for k, rule in _FLAG_RULES.items()) + " FROM pred GROUP BY cik, year), j AS (SELECT * FROM m JOIN keyword_x USING (cik, year))"


def _flags(spark, sf_dir):
    m = demo.predictions(spark, sf_dir).groupBy("cik", "year").agg(*[F.max(F.expr(rule).cast("int")).alias(k) for k, rule in _FLAG_RULES.items()])
    return compare.merge(m, compare.renamed_flags(demo.keyword(spark, sf_dir)))


_VARIANTS = {
    f"{scope}_{kind}": {"overall": ("keyword_user", f"model_{flag}_{kind}"), **{f"{t}": (f"keyword_{t}", f"model_{t}_{kind}") for t in TYPES}}
    for scope, flag in (("hedges", "user"), ("any", "any_deriv"))
    for kind, _ in _KINDS
}


@query(
    f"{_FLAGS_SQL} "
    + " UNION ALL ".join(
        f"SELECT cik, year, '{name}' AS variant, "
        + ", ".join(f"CASE WHEN {a} = {b} THEN 1 ELSE 0 END AS {k}_agree" for k, (a, b) in pairs.items())
        + f", CASE WHEN {pairs['overall'][0]} = 1 AND {pairs['overall'][1]} = 1 THEN 'True Positive' WHEN {pairs['overall'][0]} = 0 AND {pairs['overall'][1]} = 0 THEN 'True Negative' WHEN {pairs['overall'][0]} = 0 THEN 'False Positive' ELSE 'False Negative' END AS overall_classification FROM j"
        for name, pairs in _VARIANTS.items()
    )
)
def legacy_agreement(spark, sf_dir):
    """Each firm-year in four readings of the model's flags."""
    made = compare.agreements(_flags(spark, sf_dir), _VARIANTS)
    return made.select("cik", "year", "variant", *[f"{k}_agree" for k in ("overall", *TYPES)], "overall_classification")


#: The measures whose gain by history is reported.
_MEASURES = {
    **{f"Hedges Only - {m}": ("keyword_user", "user", k) for m, k in (("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"), ("F1 Score", "f1"))},
    "Any Derivative - Accuracy": ("keyword_user", "any_deriv", "accuracy"),
    "Any Derivative - Recall": ("keyword_user", "any_deriv", "recall"),
    "FX Accuracy": ("keyword_fx", "fx", "accuracy"),
    "IR Accuracy": ("keyword_ir", "ir", "accuracy"),
    "CP Accuracy": ("keyword_cp", "cp", "accuracy"),
    "Liabilities Positive Rate": (None, "liab", "positive_rate"),
    "Embedded Der. Positive Rate": (None, "embed", "positive_rate"),
}


def _measure_sql(truth: str | None, flag: str, measure: str) -> str:
    t = truth or "0"
    tp, fp, tn, fn = f"sum({t} * {flag})", f"sum((1 - {t}) * {flag})", f"sum((1 - {t}) * (1 - {flag}))", f"sum({t} * (1 - {flag}))"
    top, bottom = {"accuracy": (f"({tp} + {tn})", "count(*)"), "precision": (tp, f"({tp} + {fp})"), "recall": (tp, f"({tp} + {fn})"), "f1": (f"2 * {tp}", f"(2 * {tp} + {fp} + {fn})"), "positive_rate": (f"sum({flag})", "count(*)")}[measure]
    return f"round(coalesce({top} / nullif({bottom}::DOUBLE, 0), 0) * 100, 2)"


@query(
    f"{_FLAGS_SQL}, x AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS metric, {_measure_sql(t, f'model_{g}_current', m)} AS current_only, {_measure_sql(t, f'model_{g}_all', m)} AS current_historic FROM j" for name, (t, g, m) in _MEASURES.items())
    + ") SELECT *, round(current_historic - current_only, 2) AS improvement FROM x"
)
def history_gains(spark, sf_dir):
    return compare.improvements(_flags(spark, sf_dir), {name: (t, f"model_{g}_current", f"model_{g}_all", m) for name, (t, g, m) in _MEASURES.items()})


@query(f"WITH {KEYWORD}, {_RENAMED} SELECT * FROM keyword_x")
def keyword_renamed(spark, sf_dir):
    return compare.renamed_flags(demo.keyword(spark, sf_dir))


@query("SELECT vec_id, g AS label_group FROM (SELECT vec_id, vec_id % 18 AS label FROM embeddings) JOIN (VALUES " + ", ".join(f"('{g}', {i})" for g, ids in report.OLD_GROUPS.items() for i in ids) + ") v(g, i) ON label = i")
def legacy_groups(spark, sf_dir):
    """Rows of older labels once for each of their groups; a label of none has no row."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 18).cast("int").alias("label_id"))
    return report.in_groups(rows, "label_id", report.OLD_GROUPS).select("vec_id", "label_group")


@query(
    f"WITH {PRED}, {PRIMARY}, {_TOP_SQL}, {names_sql('; ')} SELECT url, cik, year, row_number() OVER (PARTITION BY url ORDER BY vec_id) AS sentence_num, split_part(coalesce(labels, 'Irrelevant Non-Hedge'), '; ', 1) AS primary_label, coalesce(labels, 'Irrelevant Non-Hedge') AS all_primary_labels, CASE WHEN {active_sql(', ')} = '' THEN 'None' ELSE {active_sql(', ')} END AS active_multilabels, top AS top_5_predictions, "
    + ", ".join(f"CASE WHEN {k} >= {LABEL_THRESHOLD} THEN 1 ELSE 0 END AS {k}, {k} AS prob_{k}" for k in LABELS)
    + " FROM prim LEFT JOIN names USING (vec_id) JOIN tops USING (vec_id)"
)
def inspected_sentences(spark, sf_dir):
    from pyspark.sql import Window

    d = demo.predictions(spark, sf_dir).withColumn("number", F.row_number().over(Window.partitionBy("url").orderBy("vec_id")).cast("long"))
    return report.inspected(d, ["url", "cik", "year"], "number", LABEL_THRESHOLD)


@query(f"WITH {PRED} SELECT count(DISTINCT url) AS firms, count(DISTINCT url) AS firms_with_data, count(*) AS sentences, (SELECT count(*) FROM (SELECT url FROM pred WHERE greatest(ir_use, fx_use, cp_use, eq_use, gen_use) >= {LABEL_THRESHOLD} AND curr >= {LABEL_THRESHOLD} GROUP BY url)) AS derivative_users FROM pred")
def inspection_totals(spark, sf_dir):
    return report.inspection_totals(report.inspection(demo.predictions(spark, sf_dir), ["url"], LABEL_THRESHOLD), "url", "sentences", "any_current_use")


@query(f"WITH {PRED}, {primary_sql(NOTEBOOK, True)} SELECT vec_id, coalesce(ids, '24') AS ids FROM pred LEFT JOIN (SELECT vec_id, string_agg(id::VARCHAR, ',' ORDER BY place) AS ids FROM best GROUP BY vec_id) USING (vec_id)")
def notebook_labels(spark, sf_dir):
    d = labels.resolve(demo.predictions(spark, sf_dir), NOTEBOOK, per_type=True)
    return d.select("vec_id", F.array_join(F.transform("label_ids", lambda i: i.cast("string")), ",").alias("ids"))


# Joins of the samplers and reports ------------------------------------------------------------------


@query(f"WITH {PRED}, r AS (SELECT DISTINCT cik, year, url FROM pred WHERE vec_id % 3 = 0) SELECT vec_id, cik, year, url FROM pred JOIN r USING (cik, year, url)")
def reports_with_sentences(spark, sf_dir):
    p = demo.predictions(spark, sf_dir).select("vec_id", "cik", "year", "url")
    return matrix.keyed(p, p.where("vec_id % 3 = 0"), ["cik", "year", "url"])


@query(f"{BASE} SELECT vec_id, p.cik, p.year, " + ", ".join(f"coalesce(m.{c}, 0) AS {c}" for c in MODEL_COLUMNS) + " FROM pred p LEFT JOIN (SELECT * FROM model WHERE cik % 2 = 0) m ON p.cik = m.cik AND p.year = m.year")
def sentences_with_flags(spark, sf_dir):
    p = demo.predictions(spark, sf_dir).select("vec_id", "cik", "year")
    return compare.merge(p, demo.model(spark, sf_dir).where("cik % 2 = 0").drop("url"), how="left")


@query(f"{BASE}, d AS (SELECT cik, year, url, model_user FROM model), t AS (SELECT cik, year, url, max(ir) AS model_user, count(*) AS n FROM pred WHERE ir >= 0.5 GROUP BY cik, year, url) SELECT d.cik, d.year, d.url, t.model_user, t.n FROM d LEFT JOIN t ON d.cik = t.cik AND d.year = t.year AND d.url = t.url")
def refreshed_columns(spark, sf_dir):
    """Columns of the right side replace those of the same name."""
    d = demo.model(spark, sf_dir).select("cik", "year", "url", "model_user")
    t = demo.predictions(spark, sf_dir).where("ir >= 0.5").groupBy("cik", "year", "url").agg(F.max("ir").alias("model_user"), F.count("*").alias("n"))
    return compare.refreshed(d, t, ["cik", "year", "url"])


@query("SELECT l_orderkey, l_linenumber, o_custkey, part, size FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 5 AS a, l_quantity::BIGINT % 3 AS b FROM lineitem) l JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT k, a, b, p_partkey AS part, p_size AS size FROM (SELECT *, row_number() OVER (PARTITION BY k, a, b ORDER BY p_partkey) AS r FROM (SELECT p_partkey % 50 AS k, p_partkey % 5 AS a, p_size % 3 AS b, p_partkey, p_size FROM part)) WHERE r = 1) s ON l.l_partkey % 50 = s.k AND l.a = s.a AND l.b = s.b")
def looked_up_rows(spark, sf_dir):
    """The first match on three keys, as a scan of the other table would find it."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select("l_orderkey", "l_linenumber", "o_custkey", (F.col("l_partkey") % 50).cast("long").alias("k"), (F.col("l_suppkey") % 5).cast("long").alias("a"), (F.col("l_quantity").cast("long") % 3).alias("b"))
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).cast("long").alias("k"), (F.col("p_partkey") % 5).cast("long").alias("a"), (F.col("p_size") % 3).cast("long").alias("b"), F.col("p_partkey").alias("part"), F.col("p_size").alias("size"))
    return compare.looked_up(rows, parts, ["k", "a", "b"], ["part"]).select("l_orderkey", "l_linenumber", "o_custkey", "part", "size")


@query(f"WITH {PRED}, {PRIMARY} SELECT row_number() OVER (ORDER BY primary_id, vec_id) AS place, primary_id, vec_id FROM prim ORDER BY place LIMIT 50 OFFSET 25")
def sorted_slice(spark, sf_dir):
    """Sentences by label and number, from the 26th to the 75th."""
    d = labels.resolve(demo.predictions(spark, sf_dir)).select("primary_id", "vec_id").orderBy("primary_id", "vec_id").offset(25).limit(50)
    from pyspark.sql import Window

    return d.select((F.row_number().over(Window.orderBy("primary_id", "vec_id")) + 25).cast("long").alias("place"), "primary_id", "vec_id")  # 50 rows
