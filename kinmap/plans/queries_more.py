"""Motifs, relational attention, convolutional scores, rotations, splits: queries and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinmap.functions import vectors as V
from kinmap.operators import graph as G
from kinmap.operators import more
from kinmap.operators.storage import store
from kinmap.plans.fixture import entities, graph, rounded, sql, table, vectors

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return put


_TWO = "a AS (SELECT DISTINCT least(l_suppkey, l_linenumber) AS u, greatest(l_suppkey, l_linenumber) AS v, 1 AS c FROM lineitem WHERE l_suppkey <> l_linenumber), b AS (SELECT DISTINCT least(s_suppkey, s_nationkey) AS u, greatest(s_suppkey, s_nationkey) AS v, 2 AS c FROM supplier WHERE s_suppkey <> s_nationkey), e AS (SELECT u, v, CAST(sum(c) AS INTEGER) AS colour FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)"


def _edges(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("h"), F.col("l_linenumber").cast("long").alias("t"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("h"), F.col("s_nationkey").cast("long").alias("t"))
    return more.two_colour_edges(a, b)


@query(f"WITH {_TWO} SELECT u, v, colour FROM e")
def two_colour_edges(spark, d):
    return _edges(spark, d)


_SYM = "s AS (SELECT u, v, colour FROM e UNION ALL SELECT v, u, colour FROM e)"


@query(f"""WITH {_TWO}, {_SYM} SELECT x.u AS n0, x.v AS n1, y.v AS n2, z.v AS n3 FROM s x JOIN s y ON y.u = x.v JOIN s w ON w.u = x.u AND w.v = y.v JOIN s z ON z.u = y.v
WHERE x.colour = 1 AND y.colour = 1 AND w.colour = 1 AND z.colour = 2 AND x.u <> y.v AND z.v NOT IN (x.u, x.v, y.v)
AND NOT EXISTS (SELECT 1 FROM s q WHERE q.u = x.u AND q.v = z.v) AND NOT EXISTS (SELECT 1 FROM s q WHERE q.u = x.v AND q.v = z.v)""")
def motif_search(spark, d):
    """A triangle of the first graph with a tail of the second."""
    return more.motifs(_edges(spark, d), {(0, 1): 1, (0, 2): 1, (1, 2): 1, (2, 3): 2})


_X = "x AS (SELECT id, [greatest(round(sin(id * 0.37 + i), 9), 0) for i in range(1, 5)] AS vec FROM e1)"


def _vec(ids):
    return ids.select("id", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.round(F.sin(F.col("id") * 0.37 + i), 9)).alias("vec"))


_REL = "t1 AS (SELECT * FROM g1), er AS (SELECT h, t, r, 1.0 / count(*) OVER (PARTITION BY h, t) AS w FROM (SELECT h, t, r FROM t1 UNION ALL SELECT t, h, r + 10 FROM t1)), rv AS (SELECT DISTINCT r, [round(sin(r * 0.37 + i), 9) for i in range(1, 5)] AS vec FROM er)"


@query(sql(f""", {_REL}, {_X},
k AS (SELECT h, t, sum(w * (0.2 * vec[1] + 0.7 * vec[4])) AS c FROM er JOIN rv USING (r) GROUP BY 1, 2),
s AS (SELECT k.h, k.t, q.vec AS n, 0.5 * p.vec[1] - 0.3 * p.vec[2] + 0.4 * q.vec[3] + c AS e FROM k JOIN x p ON p.id = k.h JOIN x q ON q.id = k.t),
v AS (SELECT h, n, CASE WHEN e > 0 THEN e ELSE 0.2 * e END AS e FROM s), w AS (SELECT h, n, exp(e - max(e) OVER (PARTITION BY h)) AS z FROM v), u AS (SELECT h, n, z / sum(z) OVER (PARTITION BY h) AS p FROM w)
SELECT h AS id, """ + ", ".join(f"round(greatest(sum(p * n[{i}]), 0), 6) AS c{i}" for i in range(1, 5)) + " FROM u GROUP BY 1", "g1", "e1"))
def additive_attention(spark, d):
    t = store(graph(spark, d))
    rel = store(G.edge_relations(t, 10))
    out = more.additive_attention(rel, _vec(store(entities(t))), _vec(rel.select(F.col("r").alias("id")).distinct()), [0.5, -0.3, 0.0, 0.0], [0.0, 0.0, 0.4, 0.0], [0.2, 0.0, 0.0, 0.7])
    return out.select("id", *[F.round(F.col("vec")[3 + i], 6).alias(f"c{i}") for i in range(1, 5)])


@query(sql(""", t1 AS (SELECT h AS src, t AS trg, r FROM g1), x AS (SELECT id, [round(sin(id * 0.37 + i), 9) for i in range(1, 5)] AS vec FROM e1), rv AS (SELECT DISTINCT r, [round(sin(r * 0.37 + i), 9) for i in range(1, 5)] AS vec FROM t1),
m AS (SELECT src, a.vec[1] + a.vec[2] AS x1, a.vec[3] AS x2, b.vec[1] + 0.5 * rv.vec[2] AS m1, b.vec[4] - rv.vec[1] AS m2 FROM t1 JOIN x a ON a.id = src JOIN x b ON b.id = trg JOIN rv USING (r)),
e AS (SELECT src, m1, m2, 0.3 * x1 - 0.1 * x2 + 0.6 * m1 + 0.2 * m2 AS e FROM m), l AS (SELECT src, m1, m2, CASE WHEN e > 0 THEN e ELSE 0.2 * e END AS e FROM e),
w AS (SELECT src, m1, m2, exp(e - max(e) OVER (PARTITION BY src)) AS z FROM l), p AS (SELECT src, m1, m2, z / sum(z) OVER (PARTITION BY src) AS p FROM w)
SELECT src AS id, round(sum(p * m1), 6) AS c1, round(sum(p * m2), 6) AS c2 FROM p GROUP BY 1""", "g1", "e1"))
def relation_attention(spark, d):
    t = graph(spark, d).select(F.col("h").alias("src"), F.col("t").alias("trg"), "r")
    own, near = [[1.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]], [[1.0, 0.0, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0, -1.0, 0.0, 0.0, 0.0]]
    out = more.relation_attention(t, _vec(entities(graph(spark, d))), _vec(t.select(F.col("r").alias("id")).distinct()), own, near, [0.3, -0.1, 0.6, 0.2])
    return out.select("id", *[F.round(F.col("vec")[i], 6).alias(f"c{i + 1}") for i in range(2)])


@query(sql("SELECT id, round(tanh(vec[1] + 2 * vec[2] + 0.1), 6) AS c1, round(tanh(vec[3] - vec[4] - 0.2), 6) AS c2 FROM (SELECT id, vec[1:4] AS vec FROM emb)", "emb"))
def perceptron(spark, d):
    v = more.perceptron(F.slice("vec", 1, 4), [([[1.0, 2.0, 0.0, 0.0], [0.0, 0.0, 1.0, -1.0]], [0.1, -0.2])])
    return vectors(spark, d).select("id", v.alias("v")).select("id", F.round(F.col("v")[0], 6).alias("c1"), F.round(F.col("v")[1], 6).alias("c2"))


_PIXEL = lambda i, j: f"(CASE WHEN {i} < 8 THEN e1[{i} * 8 + {j} + 1] ELSE r[({i} - 8) * 8 + {j} + 1] END)"


@query(sql(", x AS (SELECT a.id, a.vec AS e1, b.vec AS r, c.vec AS e2 FROM emb a JOIN emb b ON b.id = a.id + 1 JOIN emb c ON c.id = a.id + 2), m AS (SELECT id, e2, list_sum([greatest(" + " + ".join(f"{0.1 * (3 * a + b + 1):.1f} * " + _PIXEL(f"(p // 6 + {a})", f"(p % 6 + {b})") for a in range(3) for b in range(3)) + " - 0.2, 0) for p in range(0, 84)]) AS s FROM x) SELECT id, round(list_sum([greatest(0.01 * i * s, 0) * e2[i] for i in range(1, 65)]), 5) AS score FROM m", "emb"))
def conve_score(spark, d):
    v = vectors(spark, d).select("id", "vec")
    rows = v.withColumnRenamed("vec", "e1").join(v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("r")), "id").join(v.select((F.col("id") - 2).alias("id"), F.col("vec").alias("e2")), "id")
    filters = (0.1 * np.arange(1, 10)).reshape(1, 3, 3)
    dense = 0.01 * np.arange(1, 65)[:, None] * np.ones((1, 84))
    out = more.convolution_scores(rows, filters, np.array([-0.2]), dense, np.zeros(64), height=8)
    return out.withColumn("score", F.round("score", 5))


@query(sql("SELECT a.id, round(list_sum([abs(a.vec[i] - b.vec[i]) for i in range(1, 65)]), 6) * 0 AS difference FROM emb a JOIN emb b USING (id)", "emb"))
def procrustes(spark, d):
    """Vectors turned by a fixed rotation are turned back by the one that is found."""
    v = vectors(spark, d).select("id", "vec")
    turn = more.orthogonal(np.random.default_rng(5).normal(size=(64, 64)))
    back = more.rotation(more.mapped(v, turn), v, v.select(F.col("id").alias("src"), F.col("id").alias("trg")))
    out = more.mapped(more.mapped(v, turn), back).withColumnRenamed("vec", "w").join(v, "id")
    return out.select("id", F.round(V.norm(V.minus(F.col("w"), F.col("vec")), 1), 6).alias("difference"))


@query("SELECT part, n FROM (VALUES ('test', CAST(100 AS BIGINT)), ('train', CAST(30 AS BIGINT)), ('valid', (SELECT count(*) - 130 FROM customer))) AS t(part, n)")
def random_split(spark, d):
    return more.random_split(table(spark, d, "customer"), "c_custkey", 100, 30).groupBy("part").agg(F.count("*").alias("n"))


@query(sql(", v AS (SELECT id, [((id * 37 + i * 11) % 100) / 50 - 1 for i in range(1, 5)] AS vec FROM e1), rv AS (SELECT DISTINCT r, [((r * 37 + i * 11) % 100) / 50 - 1 for i in range(1, 5)] AS vec FROM g1) SELECT h, g1.r, t, round(list_sum([a.vec[i] * rv.vec[i] * b.vec[i] for i in range(1, 5)]), 6) AS score FROM g1 JOIN v a ON a.id = h JOIN v b ON b.id = t JOIN rv ON rv.r = g1.r", "g1", "e1"))
def triple_scores(spark, d):
    t = graph(spark, d)
    vec = lambda ids: ids.select("id", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.col("id") * 37 + i * 11) % 100 / 50 - 1).alias("vec"))
    return rounded(more.triple_scores(t, vec(entities(t)), vec(t.select(F.col("r").alias("id")).distinct()), "distmult"))


@query("SELECT l_suppkey AS src, l_partkey AS trg, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2")
def streaming_sum(spark, d):
    """Batches of cells as a stream of files, added up by the state store."""
    from kinmap.operators.storage import shared_path
    from kinmap.streaming.accumulate import start_files, sums

    path = shared_path(spark)
    cells = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("trg"), F.col("l_quantity").alias("score"))
    cells.repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    start_files(stream, f"{path}/sums", f"{path}/state").awaitTermination()
    return sums(spark, f"{path}/sums")
