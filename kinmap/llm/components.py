"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import materialize, remove, shared_dir, spread


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, root): every node that has an edge, with the smallest node it reaches.

    Each round points all neighbours above a node at its smallest neighbour and so
    never adds rows: n edges stay n at most, whatever the size of a component. Minima are
    pre-aggregated before they are shuffled, and a hub's edges are joined in shares.
    Rounds are written to the shared folder; only two sums come to the driver.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    at = shared_dir(spark)
    e, before = materialize(e, at), None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before = tuple(now)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = spread(both.filter("v > u"), low, "u", "v").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = spread(large, low, "u", "v").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        to = shared_dir(spark)
        e = materialize(small.union(low.select("u", "low")).distinct(), to)
        remove(spark, at)
        at = to
    raise RuntimeError(f"no convergence in {most_rounds} rounds")
