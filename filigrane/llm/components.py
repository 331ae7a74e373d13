"""Connected components of an undirected graph held as rows of edges.

Alternating large-star and small-star passes (Kiveris et al., 2014), stored after
each pair: a pass reads its edges more than once, so plans of several would
double. A pass groups each node's neighbours by a minimum, which combines before the shuffle,
so a node with very many neighbours costs one row a task. No node's neighbours
are ever gathered into a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.llm.state import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        made = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u != m").select("u", F.col("m").alias("v")))
    return made.where("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) of one orderable type → (node, root) for each node with an edge; root is the least node of its component.

    An empty table gives an empty table; loops, repeated and reversed edges change nothing.
    """
    edges = cut(edges.where("u != v").select("u", "v").distinct())
    sign = None
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
