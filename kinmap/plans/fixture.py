"""Two overlapping graphs, links, parts and vector sets derived from the business tables; the same text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("lineitem", "orders", "supplier", "customer", "nation")
BASE = """
  SELECT l_partkey AS h, 1 AS r, 1000000 + l_suppkey AS t, l_orderkey AS k FROM {lineitem}
  UNION ALL
  SELECT 2000000 + o_custkey, 2, l_partkey, l_orderkey FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
  UNION ALL
  SELECT 1000000 + s_suppkey, 3, 3000000 + s_nationkey, s_suppkey FROM {supplier}
  UNION ALL
  SELECT 2000000 + c_custkey, 4, 3000000 + c_nationkey, c_custkey FROM {customer}
  UNION ALL
  SELECT 3000000 + n_nationkey, 5, 4000000 + n_regionkey, n_nationkey FROM {nation}
"""
GRAPH1 = f"SELECT DISTINCT CAST(h AS BIGINT) AS h, CAST(r AS BIGINT) AS r, CAST(t AS BIGINT) AS t FROM ({BASE}) b WHERE k % 5 <> 1"
GRAPH2 = f"SELECT DISTINCT CAST(h AS BIGINT) + 10000000 AS h, CAST(r AS BIGINT) AS r, CAST(t AS BIGINT) + 10000000 AS t FROM ({BASE}) b WHERE k % 5 <> 2"
#: CTEs for the SQL side: g1, g2 (triples), e1, e2 (entities), link (src, trg, is_train), emb (id, vec), cell (every src, trg, score), sim (the 50 best cells of each src).
_named = {t: t for t in TABLES}
CTES = {
    "g1": GRAPH1.format(**_named),
    "g2": GRAPH2.format(**_named),
    "e1": "SELECT h AS id FROM g1 UNION SELECT t FROM g1",
    "e2": "SELECT h AS id FROM g2 UNION SELECT t FROM g2",
    "link": "SELECT e1.id AS src, e2.id AS trg, e1.id % 5 = 0 AS is_train FROM e1 JOIN e2 ON e2.id = e1.id + 10000000",
    "train": "SELECT src, trg FROM link WHERE is_train",
    "emb": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings",
    "va": "SELECT id, vec FROM emb WHERE id % 2 = 0",
    "vb": "SELECT id, vec FROM emb WHERE id % 2 = 1",
    "cell": "SELECT va.id AS src, vb.id AS trg, 1 - list_distance(va.vec, vb.vec) * list_distance(va.vec, vb.vec) AS score FROM va, vb",
    "sim": "SELECT src, trg, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, trg) AS place FROM cell) WHERE place <= 50",
    "cells": "SELECT l_suppkey AS src, l_partkey AS trg, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2",
}
_NEEDS = {"e1": ["g1"], "e2": ["g2"], "link": ["g1", "g2", "e1", "e2"], "train": ["g1", "g2", "e1", "e2", "link"], "va": ["emb"], "vb": ["emb"], "cell": ["emb", "va", "vb"], "sim": ["emb", "va", "vb", "cell"]}
#: Read more than once, and dear: DuckDB shall not put their text in for each.
_ONCE = ("emb", "va", "vb", "cell", "sim", "g1", "g2", "e1", "e2")


def sql(body: str, *names: str) -> str:
    """``body`` with the named CTEs, and what those need, in front. A body may go on with more CTEs: it then starts with ", name AS"."""
    order = [n for n in CTES if n in {x for y in names for x in [*_NEEDS.get(y, []), y]}]
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in _ONCE else ''}({CTES[n]})" for n in order) + (f"\n{body}" if not body.lstrip().startswith(",") else body)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def graph(spark: SparkSession, d: str, which: int = 1) -> DataFrame:
    return spark.sql(GRAPH1 if which == 1 else GRAPH2, **{t: table(spark, d, t) for t in TABLES})


def entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("h").alias("id")).union(triples.select("t")).distinct()


def links(spark: SparkSession, d: str) -> DataFrame:
    return linked(graph(spark, d, 1), graph(spark, d, 2))


def linked(triples1: DataFrame, triples2: DataFrame) -> DataFrame:
    """``links`` of graphs that are there already."""
    a = entities(triples1).select(F.col("id").alias("src"), (F.col("id") + 10_000_000).alias("trg"))
    return a.join(entities(triples2).select(F.col("id").alias("trg")), "trg").select("src", "trg", (F.col("src") % 5 == 0).alias("is_train"))


def train(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).filter("is_train").select("src", "trg")


def vectors(spark: SparkSession, d: str, rest: int | None = None) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return v if rest is None else v.filter(F.col("id") % 2 == rest).select("id", "vec")


def similarity(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best cells of each even vector among the odd ones: 1 - squared distance."""
    from kinmap.operators.knn import nearest

    return nearest(vectors(spark, d, 0), vectors(spark, d, 1), 50)


def every_cell(spark: SparkSession, d: str, metric: str = "sqeuclidean") -> DataFrame:
    """All cells of the even and the odd vectors, for operators whose result is the dense matrix."""
    from kinmap.operators.knn import dense

    return dense(vectors(spark, d, 0), vectors(spark, d, 1), metric)


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Quantity of each supplier and part."""
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("trg")).agg(F.sum("l_quantity").alias("score"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns or ("score",):
        df = df.withColumn(c, F.round(c, 6))
    return df
