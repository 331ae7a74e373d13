"""Label matrices and firm-level group tests: histograms, co-occurrence, crosses, selections."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_histogram(rows: DataFrame, keys: list[str], label: str, values: list) -> DataFrame:
    """Rows of each label by report, wide, 0 where none; the fixed list of values makes the plan one aggregation."""
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col(label) == v).alias(f"count_{v}") for v in values])


def unique_firms(wide: DataFrame, labels: list[str], firm: str = "cik", year: str = "year") -> DataFrame:
    """Distinct firms with a count above 0, by year and label."""
    long = wide.unpivot([firm, year], labels, "label", "value").where("value > 0")
    return long.groupBy(year, "label").agg(F.countDistinct(firm).alias("firms"))


def co_occurrence(wide: DataFrame, labels: list[str]) -> DataFrame:
    """(a, b, n): rows in which both labels are above 0; n of (a, a) is the support. One aggregation, half of the square."""
    half = [(a, b) for i, a in enumerate(labels) for b in labels[i:]]
    on = lambda k: f"coalesce(CAST(`{k}` AS DOUBLE) > 0, false)"
    one = wide.agg(F.expr(f"array({', '.join(f'count_if({on(a)} AND {on(b)})' for a, b in half)})").alias("n"))
    place = {p: i for i, p in enumerate(half)}
    cells = ", ".join(f"named_struct('a', '{a}', 'b', '{b}', 'n', n[{place.get((a, b), place.get((b, a)))}])" for a, b in product(labels, labels))
    return one.selectExpr(f"inline(array({cells}))")


def type_cross(wide: DataFrame, groups: dict[str, list[str]], firm: str = "cik") -> DataFrame:
    """Co-occurrence of types over firms; a firm has a type if any of its label columns is ever above 0."""
    any_of = lambda cols: F.max(F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in cols], F.lit(0)) if len(cols) > 1 else F.coalesce(F.col(cols[0]), F.lit(0)))
    firms = wide.groupBy(firm).agg(*[any_of(cols).alias(k) for k, cols in groups.items()])
    return co_occurrence(firms, list(groups))


def rows_by_type(wide: DataFrame, groups: dict[str, list[str]], keys: tuple[str, ...] = ("cik", "year")) -> DataFrame:
    """Each row once for every type that its firm-year has anywhere, tagged by type."""
    total = lambda cols: sum((F.coalesce(F.col(c), F.lit(0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0)))
    sums = wide.groupBy(*keys).agg(*[F.sum(total(cols)).alias(f"_{k}") for k, cols in groups.items()])
    tags = F.array_compact(F.array(*[F.when(F.col(f"_{k}") > 0, k) for k in groups]))
    return wide.join(sums.select(*keys, F.explode(tags).alias("hedge_type")), list(keys))


def firms_where(wide: DataFrame, condition: Column, firm: str = "cik") -> DataFrame:
    """Rows of firms whose aggregates meet a condition (an aggregate expression)."""
    passing = wide.groupBy(firm).agg(condition.alias("_ok")).where("_ok").select(firm)
    return wide.join(passing, firm, "left_semi")


def keyed(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Semi join on a composite key."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def not_yet(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Anti join: rows whose key hasn't been worked on."""
    return df.join(done.select(*on).distinct(), on, "left_anti")


def width_histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins between the least and the largest value: (bin from 1, n). The range is one row, broadcast."""
    v = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = v.join(F.broadcast(span)).select(F.least(F.lit(bins), F.floor(F.coalesce(F.try_divide((F.col("v") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))).cast("int") + 1).alias("bin"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"))
