"""Reports: labelled sentences, group summaries, firm inspection, top scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigrane.functions.taxonomy import FINANCE, Taxonomy
from filigrane.operators.labels import name_of, resolve

# The report's workbooks and the labels of each; context stands with its type.
GROUPS = {
    "General_Hedge": (0, 1, 2, 15),
    "IR_Hedge": (3, 4, 5, 16),
    "FX_Hedge": (6, 7, 8, 17),
    "CP_Hedge": (9, 10, 11, 18),
    "EQ_Hedge": (12, 13, 14, 19),
    "Warrant": (20, 21),
    "Embedded_Derivative": (22, 23),
    "Speculation": (),
    "Irrelevant": (24,),
}
# The older groups, over older ids; four labels belong to two of them.
OLD_GROUPS = {
    "Gen_Hedge_0-1-2": (0, 1, 2),
    "Speculation_Policy_2_14_15_16": (2, 14, 15, 16),
    "Irrelevant_3": (3,),
    "Liabilities_Warrants_4-5": (4, 5),
    "Embedded_Derivatives_6-7": (6, 7),
    "IR_Hedge_8-9-14": (8, 9, 14),
    "FX_Hedge_10-11-15": (10, 11, 15),
    "CP_Hedge_12-13-16": (12, 13, 16),
}


def labelled_sentences(rows: DataFrame, keys: list[str], threshold: float, tax: Taxonomy = FINANCE) -> DataFrame:
    """A record a sentence: keys, primary label, all labels joined, active labels, top scores and the rounded probabilities."""
    d = resolve(rows, tax, threshold)
    names = F.array_join(F.transform("label_ids", lambda i: name_of(i, tax)), ", ")
    active = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.col(k), F.lit(0.0)) >= threshold, k) for k in tax.labels])), "; ")
    return d.select(*keys, "primary_id", name_of(F.col("primary_id"), tax).alias("primary_label"), F.round("primary_score", 6).alias("primary_score"), "tier", names.alias("labels"), active.alias("active"), top_scores(tax).alias("top"), *[F.col(k).alias(f"prob_{k}") for k in tax.labels])


def top_scores(tax: Taxonomy = FINANCE, n: int = 5, digits: int = 3) -> Column:
    """The n largest probabilities as label:score, largest first; ties keep the labels' order."""
    pairs = F.array(*[F.struct((-F.coalesce(F.col(k), F.lit(0.0))).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(tax.labels)])
    return F.array_join(F.transform(F.slice(F.array_sort(pairs), 1, n), lambda x: F.concat(x["k"], F.lit(":"), F.format_string(f"%.{digits}f", -x["s"]))), ", ")


def paired(matches: Column, preds: Column) -> Column:
    """Sentences with their predictions by place, as many as the shorter array has."""
    n = F.least(F.size(matches), F.size(preds))
    return F.arrays_zip(F.slice(matches, F.lit(1), n).alias("sentence"), F.slice(preds, F.lit(1), n).alias("pred"))


def flat_matches(json_column: Column) -> Column:
    """The sentences of a JSON map of arrays, in the map's order, or of a plain JSON array; null if neither."""
    by_category = F.from_json(json_column, "map<string,array<string>>")
    return F.coalesce(F.flatten(F.filter(F.map_values(by_category), lambda v: v.isNotNull())), F.from_json(json_column, "array<string>"))


def in_groups(rows: DataFrame, label_id: str, groups: dict[str, tuple[int, ...]] = GROUPS) -> DataFrame:
    """Each row once for every group its label belongs to."""
    tags = F.array_compact(F.array(*[F.when(F.col(label_id).isin(*ids), g) for g, ids in groups.items() if ids]))
    return rows.select("*", F.explode(tags).alias("label_group"))


def group_summary(rows: DataFrame, label_id: str, firm: str, url: str, year: str, groups: dict[str, tuple[int, ...]] = GROUPS) -> DataFrame:
    """Per group and label: sentences, their share of the group, firms, urls, averages and years; a TOTAL row a group.

    Grouping sets give labels and totals in one aggregation."""
    own = in_groups(rows, label_id, groups)
    by = own.groupingSets([["label_group", label_id], ["label_group"]], "label_group", label_id).agg(
        F.grouping(label_id).alias("_total"), F.count("*").alias("total"), F.countDistinct(firm).alias("firms"), F.countDistinct(url).alias("urls"), F.min(year).alias("first_year"), F.max(year).alias("last_year")
    )
    w = Window.partitionBy("label_group")
    whole = F.max(F.when(F.col("_total") == 1, F.col("total"))).over(w)
    label = F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col(label_id).cast("string"))
    return by.select("label_group", label.alias("label"), "total", F.round(F.col("total") * 100.0 / whole, 2).alias("pct_of_group"), "firms", "urls", F.round(F.col("total") / F.col("firms"), 2).alias("per_firm"), F.round(F.col("total") / F.col("urls"), 2).alias("per_url"), "first_year", "last_year")


def overall_summary(rows: DataFrame, label_id: str, tax: Taxonomy = FINANCE) -> DataFrame:
    """(label_id, label, total, pct_of_total) over all sentences."""
    by = rows.groupBy(label_id).agg(F.count("*").alias("total"))
    whole = F.sum("total").over(Window.partitionBy())
    return by.select(F.col(label_id).alias("label_id"), name_of(F.col(label_id), tax).alias("label"), "total", F.round(F.col("total") * 100.0 / whole, 2).alias("pct_of_total"))


def inspection(rows: DataFrame, keys: list[str], threshold: float, tax: Taxonomy = FINANCE) -> DataFrame:
    """Per report: sentences in which use and present time meet, any present time, the most frequent primary label (the least of ties) and the counts of labels."""
    d = resolve(rows, tax, threshold)
    on = lambda k: F.coalesce(F.col(k), F.lit(0.0)) >= threshold
    now = on(tax.times[0])
    counts = [F.count_if(on(f"{t}_use") & now).alias(f"{t}_current_use") for t in tax.types]
    any_use = on(f"{tax.types[0]}_use")
    for t in tax.types[1:]:
        any_use = any_use | on(f"{t}_use")
    labels = [F.count_if(F.col("primary_id") == i).alias(f"count_{i}") for i in tax.names]
    return d.groupBy(*keys).agg(F.count("*").alias("sentences"), *counts, F.count_if(any_use & now).alias("any_current_use"), F.expr("mode() WITHIN GROUP (ORDER BY primary_id)").alias("mode_label"), *labels)


def inspected(rows: DataFrame, keys: list[str], number: str, threshold: float, tax: Taxonomy = FINANCE) -> DataFrame:
    """A record a sentence for a reader: its number in the report, primary and all labels, active multi-labels ("None" where there are none), top scores, each label as 0 or 1 and as its probability."""
    d = resolve(rows, tax, threshold)
    p = {k: F.coalesce(F.col(k), F.lit(0.0)) for k in tax.labels}
    active = F.array_join(F.array_compact(F.array(*[F.when(p[k] >= threshold, k) for k in tax.labels])), ", ")
    names = F.array_join(F.transform("label_ids", lambda i: name_of(i, tax)), "; ")
    return d.select(
        *keys,
        F.col(number).alias("sentence_num"),
        name_of(F.col("primary_id"), tax).alias("primary_label"),
        names.alias("all_primary_labels"),
        F.when(active == "", "None").otherwise(active).alias("active_multilabels"),
        top_scores(tax).alias("top_5_predictions"),
        *[(p[k] >= threshold).cast("int").alias(k) for k in tax.labels],
        *[p[k].alias(f"prob_{k}") for k in tax.labels],
    )


def inspection_totals(reports: DataFrame, url: str, sentences: str, users: str) -> DataFrame:
    """One row over reports: firms analysed, with data, sentences processed, and firms that use derivatives."""
    return reports.agg(
        F.countDistinct(url).alias("firms"), F.countDistinct(F.when(F.col(sentences) > 0, F.col(url))).alias("firms_with_data"), F.coalesce(F.sum(sentences), F.lit(0)).alias("sentences"), F.countDistinct(F.when(F.col(users) > 0, F.col(url))).alias("derivative_users")
    )


def sentence_block(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Sentences of each report in order, with a blank line between."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["t"]), "\n\n").alias("block"))


def sheet_name(name: Column) -> Column:
    """A name that a workbook accepts: without []:*?/\\ and at most 31 characters."""
    return F.left(F.regexp_replace(name, r"[\[\]:*?/\\]", "_"), F.lit(31))


def first_label(joined: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(joined, ", "), 1), F.lit("")), F.lit("Irrelevant"))


def review_sheet(rows: DataFrame, fixed: list[str], blank: tuple[str, ...] = ("reviewer_label", "reviewer_note")) -> DataFrame:
    """Fixed columns, empty ones for a reviewer, then the model's flags by name."""
    return rows.select(*fixed, *[F.lit("").alias(c) for c in blank], *sorted(c for c in rows.columns if c.startswith("model_")))


def label_vector(label_map: Column, labels: tuple[str, ...]) -> Column:
    """A map of labels as an array in fixed order; a missing label is 0."""
    return F.array(*[F.coalesce(label_map[k], F.lit(0)) for k in labels])


def priority_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """Named columns first, the rest in order of name."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *sorted(c for c in df.columns if c not in head))
