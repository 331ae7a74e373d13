"""Usage flags of reports and their firm-year rollup, and the keyword baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.functions.taxonomy import FINANCE, Taxonomy

#: Types whose flags make up "user"; "user_all" takes any use, without a test of time.
CORE = ("ir", "fx", "cp")
KEYWORD_FLAGS = ("user", "ir_user", "fx_user", "cp_user")


def report_flags(counts: DataFrame, tax: Taxonomy = FINANCE) -> DataFrame:
    """Counts of a report (n_<label>) → model_<type>_user and so on as 0/1. Use and time may come from different sentences."""
    n = lambda k: F.col(f"n_{k}") > 0
    flag = lambda c: c.cast("int")
    now = n(tax.times[0])
    each = {t: n(f"{t}_use") & now for t in tax.specific}
    more = {x: n(x) & now for x in tax.extras}
    any_use = n(f"{tax.types[0]}_use")
    for k in (*[f"{t}_use" for t in tax.types[1:]], *tax.extras):
        any_use = any_use | n(k)
    user = each[CORE[0]]
    for t in CORE[1:]:
        user = user | each[t]
    made = {f"model_{k}_user": flag(c) for k, c in (each | more).items()}
    keys = [c for c in counts.columns if not c.startswith("n_")]
    return counts.select(*keys, *[c.alias(k) for k, c in made.items()], flag(user).alias("model_user"), flag(any_use).alias("model_user_all"))


def firm_years(flags: DataFrame, order: Column, keys: tuple[str, ...] = ("cik", "year"), url: str = "url") -> DataFrame:
    """Largest of each model_ flag by firm and year, and the url that is first by order."""
    names = [c for c in flags.columns if c.startswith("model_")]
    return flags.groupBy(*keys).agg(*[F.max(c).alias(c) for c in names], F.min_by(url, order).alias(url))


def keyword_flags(rows: DataFrame, keys: tuple[str, ...] = ("cik", "year"), names: tuple[str, ...] = KEYWORD_FLAGS) -> DataFrame:
    """The baseline's flags by firm and year."""
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in names])
