"""Reproducible samples: rows in the order of an md5 of seed and key.

A stratum's rows are ranked by a window; Spark's group limit keeps only the
first n of each stratum before the shuffle, so a hot stratum costs n rows a
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def order_key(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def stratified(df: DataFrame, stratum: list[str], key: str, n: int, seed: int = SEED) -> DataFrame:
    """At most n rows of each stratum."""
    w = Window.partitionBy(*stratum).orderBy(order_key(F.col(key), seed), F.col(key))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def fraction(df: DataFrame, stratum: list[str], key: str, share: float, seed: int = SEED) -> DataFrame:
    """A rounded share of each stratum.

    The first hex digits of the order's hash cut a stratum into 4096 slices, which are counted; slices wholly below the
    share pass, and only the slice that the share cuts is ranked, so a hot stratum never is one task."""
    sliced = df.withColumn("_slice", F.left(order_key(F.col(key), seed), F.lit(3)))
    counts = sliced.groupBy(*stratum, "_slice").agg(F.count("*").alias("_m"))
    w = Window.partitionBy(*stratum)
    before = F.sum("_m").over(w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    spots = counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_want": F.round(F.sum("_m").over(w) * share)}).where("_before < _want")
    keys = (*stratum, "_slice")
    spots = spots.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], "_m", "_before", "_want")
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"_key{i}"))
    near = sliced.join(spots, on)
    whole = near.where("_before + _m <= _want")
    cut = near.where("_before + _m > _want").withColumn("_rank", F.row_number().over(Window.partitionBy(*stratum, "_slice").orderBy(order_key(F.col(key), seed), F.col(key)))).where("_before + _rank <= _want")
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def first_of_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def shuffled(df: DataFrame, key: str, n: int | None = None, seed: int = SEED) -> DataFrame:
    """Rows in a seeded order; with n, the first n."""
    out = df.orderBy(order_key(F.col(key), seed), key)
    return out.limit(n) if n is not None else out


def split(df: DataFrame, key: str, share: float = 0.8, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by a hash of the key, the same in every run."""
    bucket = F.pmod(F.conv(F.left(order_key(F.col(key), seed), F.lit(7)), 16, 10).cast("long"), F.lit(1000))
    return df.where(bucket < int(share * 1000)), df.where(bucket >= int(share * 1000))


def non_matches(df: DataFrame, matched: Column, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows that match nothing, in place of a reservoir."""
    return shuffled(df.where(~matched), key, n, seed)
