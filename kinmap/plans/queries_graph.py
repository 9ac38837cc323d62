"""Knowledge graphs: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmap.functions import vectors as V
from kinmap.operators import graph as G
from kinmap.operators import match, sparse
from kinmap.operators.storage import store
from kinmap.plans.fixture import entities, graph, linked, links, rounded, sql, table, train, vectors
from kinmap.sources import graphs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return put


@query(sql("SELECT 1 AS kg, r, count(*) AS n, sum(h) AS heads, sum(t) AS tails FROM g1 GROUP BY r UNION ALL SELECT 2, r, count(*), sum(h), sum(t) FROM g2 GROUP BY r", "g1", "g2").replace("sum(h)", "CAST(sum(h) AS BIGINT)").replace("sum(t)", "CAST(sum(t) AS BIGINT)"))
def triples_encode(spark, d):
    one = lambda k: graph(spark, d, k).groupBy("r").agg(F.count("*").alias("n"), F.sum("h").alias("heads"), F.sum("t").alias("tails")).select(F.lit(k).alias("kg"), "*")
    return one(1).unionByName(one(2))


@query("SELECT source AS key, row_number() OVER (ORDER BY min(doc_id)) - 1 AS id FROM documents GROUP BY source")
def dictionary_encode(spark, d):
    return graphs.dictionary(table(spark, d, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("pos")))


@query(sql("SELECT src, trg, place, place < CAST(floor(0.3 * (SELECT count(*) FROM link)) AS BIGINT) AS is_train FROM (SELECT src, trg, row_number() OVER (ORDER BY src) - 1 AS place FROM link)", "link"))
def train_split(spark, d):
    pairs = links(spark, d).select(F.col("src").alias("pos"), "src", "trg")
    return graphs.split_links(pairs, 0.3)


@query(sql("SELECT r, round(count(DISTINCT h) / count(*), 6) AS func, round(count(DISTINCT t) / count(*), 6) AS inverse FROM g1 GROUP BY r", "g1"))
def rel_func(spark, d):
    return rounded(G.functionality(graph(spark, d)), "func", "inverse")


_WEIGHTED = ", f AS (SELECT r, count(DISTINCT h) / count(*) AS f, count(DISTINCT t) / count(*) AS i FROM g1 GROUP BY r), w AS (SELECT src, trg, sum(s) AS score FROM (SELECT t AS src, h AS trg, greatest(i, 0.3) AS s FROM g1 JOIN f USING (r) WHERE h <> t UNION ALL SELECT h, t, greatest(f, 0.3) FROM g1 JOIN f USING (r) WHERE h <> t) GROUP BY 1, 2)"


@query(sql(_WEIGHTED + " SELECT src, trg, round(score, 6) AS score FROM w", "g1"))
def weighted_adj(spark, d):
    return rounded(G.weighted_adjacency(store(graph(spark, d))))


@query(sql(_WEIGHTED + ", dg AS (SELECT src AS n, sum(score) AS x FROM w GROUP BY 1) SELECT w.src, w.trg, round(score / sqrt(a.x) / sqrt(b.x), 6) AS score FROM w JOIN dg a ON a.n = w.src JOIN dg b ON b.n = w.trg", "g1"))
def degree_norm(spark, d):
    return rounded(G.normalized(store(G.weighted_adjacency(store(graph(spark, d))))))


_BOTH = ", u AS (SELECT DISTINCT h AS src, t AS trg FROM (SELECT h, t FROM g1 UNION ALL SELECT t, h FROM g1 UNION ALL SELECT id, id FROM e1))"


@query(sql(_BOTH + ", dg AS (SELECT src AS n, count(*) AS x FROM u GROUP BY 1) SELECT u.src, u.trg, round(1 / sqrt(a.x) / sqrt(b.x), 6) AS score FROM u JOIN dg a ON a.n = u.src JOIN dg b ON b.n = u.trg", "g1", "e1"))
def entity_features(spark, d):
    t = graph(spark, d)
    return rounded(G.normalized(G.linked_entities(t, entities(t))))


@query("SELECT l_partkey AS h, l_suppkey AS t, count(*) AS n FROM lineitem GROUP BY 1, 2")
def edge_counts(spark, d):
    return G.edge_counts(table(spark, d, "lineitem").select(F.col("l_partkey").alias("h"), F.col("l_linenumber").alias("r"), F.col("l_suppkey").alias("t")))


@query(sql("SELECT id, r, way, count(*) AS n FROM (SELECT h AS id, r, 'out' AS way FROM g1 UNION ALL SELECT t, r, 'in' FROM g1) GROUP BY 1, 2, 3", "g1"))
def relation_features(spark, d):
    return G.relation_features(graph(spark, d))


@query("""WITH x AS (SELECT DISTINCT l_partkey AS h, CAST(l_linenumber AS BIGINT) AS r, l_suppkey AS t FROM lineitem), b AS (SELECT h, t, r FROM x UNION ALL SELECT t, h, r + 10 FROM x)
SELECT h, t, r, round(1.0 / count(*) OVER (PARTITION BY h, t), 6) AS w FROM b""")
def rel_incidence(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("h"), F.col("l_linenumber").cast("long").alias("r"), F.col("l_suppkey").alias("t")).distinct()
    return rounded(G.edge_relations(x, 10), "w")


@query(sql("SELECT h, t, r FROM g1 WHERE h <> t UNION ALL SELECT t, h, r FROM g1 WHERE h <> t", "g1"))
def multi_edges(spark, d):
    return G.multi_edges(graph(spark, d), with_relations=True)


@query(sql("SELECT DISTINCT h, t FROM (SELECT h, t FROM g1 WHERE h <> t UNION ALL SELECT t, h FROM g1 WHERE h <> t) UNION ALL SELECT id, id FROM e1", "g1", "e1"))
def simple_edges(spark, d):
    t = graph(spark, d)
    return G.multi_edges(t, entities(t))


@query(sql("SELECT id, count(DISTINCT n) AS size, min(n) AS first, max(n) AS last FROM (SELECT h AS id, t AS n FROM g1 WHERE h <> t UNION ALL SELECT t, h FROM g1 WHERE h <> t) GROUP BY id", "g1"))
def neighbour_sets(spark, d):
    return G.neighbour_sets(graph(spark, d)).select("id", F.size("near").cast("long").alias("size"), F.col("near")[0].alias("first"), F.element_at("near", -1).alias("last"))


@query(sql("SELECT r, count(DISTINCT h) AS heads, count(DISTINCT t) AS tails, min(h) AS low, max(t) AS high FROM g1 GROUP BY r", "g1"))
def relation_ends(spark, d):
    e = graphs.relation_ends(graph(spark, d))
    return e.select("r", F.size("heads").cast("long").alias("heads"), F.size("tails").cast("long").alias("tails"), F.col("heads")[0].alias("low"), F.element_at("tails", -1).alias("high"))


@query("""WITH a AS (SELECT c_custkey AS id, c_mktsegment AS attribute FROM customer UNION ALL SELECT s_suppkey + 1000000, 'nation ' || s_nationkey FROM supplier UNION ALL SELECT c_custkey, 'nation ' || c_nationkey FROM customer),
k AS (SELECT attribute FROM (SELECT attribute, row_number() OVER (ORDER BY count(*) DESC, attribute) AS n FROM a GROUP BY attribute) WHERE n <= 12) SELECT DISTINCT id, attribute FROM a WHERE attribute IN (SELECT attribute FROM k)""")
def top_attributes(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    nation = lambda col: F.concat(F.lit("nation "), F.col(col).cast("string"))
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("attribute")).union(s.select(F.col("s_suppkey") + 1000000, nation("s_nationkey"))).union(c.select("c_custkey", nation("c_nationkey")))
    return G.top_attributes(rows, 12)


@query(sql("SELECT h, r, t FROM g2 UNION ALL SELECT a.trg, r, b.trg FROM g1 JOIN train a ON a.src = h JOIN train b ON b.src = t", "g1", "g2", "train"))
def share_triples(spark, d):
    return G.shared_triples(graph(spark, d, 1), graph(spark, d, 2), train(spark, d))


@query(sql("SELECT DISTINCT coalesce(a.trg, h) AS h, r, coalesce(b.trg, t) AS t FROM g1 LEFT JOIN train a ON a.src = h LEFT JOIN train b ON b.src = t", "g1", "train"))
def substitute_triples(spark, d):
    return G.substituted(graph(spark, d), train(spark, d))


_TWO = ", g AS (SELECT * FROM g1 UNION SELECT * FROM g2), p AS (SELECT src AS a, trg AS b FROM train UNION SELECT trg, src FROM train)"


def _both(spark, d):
    return graph(spark, d, 1).union(graph(spark, d, 2)).distinct()


@query(sql(_TWO + " SELECT h, r, t FROM g UNION SELECT b, r, t FROM g JOIN p ON a = h UNION SELECT h, r, b FROM g JOIN p ON a = t", "g1", "g2", "train"))
def swap_triples(spark, d):
    return G.swapped(_both(spark, d), train(spark, d))


@query(sql(_TWO + " SELECT b AS h, r, t FROM g JOIN p ON a = h UNION SELECT h, r, b FROM g JOIN p ON a = t", "g1", "g2", "train"))
def boot_triples(spark, d):
    return G.boot_triples(_both(spark, d), train(spark, d))


_PARTS = ", p1 AS (SELECT id, id % 5 AS part FROM e1), p2 AS (SELECT id, (id // 3) % 5 AS part FROM e2)"


def _parts(spark, d):
    return _parts_of(graph(spark, d, 1), graph(spark, d, 2))


def _parts_of(t1, t2):
    a = entities(t1).withColumn("part", F.col("id") % 5)
    b = entities(t2).withColumn("part", F.floor(F.col("id") / 3) % 5)
    return a, b


@query(sql(_PARTS + " SELECT a.part, h, r, t FROM g1 JOIN p1 a ON a.id = h JOIN p1 b ON b.id = t WHERE a.part = b.part", "g1", "e1", "e2"))
def place_triples(spark, d):
    return G.placed(graph(spark, d), _parts(spark, d)[0])


_OVERLAP = _PARTS + ", s AS (SELECT part, trg AS id FROM train JOIN p1 ON p1.id = src), z AS (SELECT part, count(*) AS n FROM s GROUP BY 1), o AS (SELECT s.part AS src, p2.part AS trg, count(*) / (max(z.n) + 0.01) AS score FROM s JOIN p2 USING (id) JOIN z ON z.part = s.part GROUP BY 1, 2)"


@query(sql(_OVERLAP + " SELECT src, trg, round(score, 6) AS score FROM o", "e1", "e2", "train"))
def part_overlap(spark, d):
    a, b = _parts(spark, d)
    seeds = train(spark, d).join(a.select(F.col("id").alias("src"), "part"), "src").select("part", F.col("trg").alias("id"))
    return rounded(G.overlaps(seeds, b))


_BATCH = _OVERLAP + ", best AS (SELECT src, trg FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, trg) AS n FROM o) WHERE n <= 2), m AS (SELECT part AS batch, 1 AS side, id FROM p1 UNION ALL SELECT src, 2, id FROM best JOIN p2 ON part = trg)"


@query(sql(_BATCH + " SELECT batch, side, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM m GROUP BY 1, 2", "e1", "e2", "train"))
def batch_sampler(spark, d):
    a, b = _parts(spark, d)
    return G.batches(a, b, train(spark, d), 2).groupBy("batch", "side").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query(sql(_BATCH + " SELECT m.batch, 1 AS side, count(*) AS n, CAST(sum(h) AS BIGINT) AS heads FROM g1 JOIN m ON m.id = h AND m.side = 1 JOIN m n ON n.id = t AND n.side = 1 AND n.batch = m.batch GROUP BY 1 UNION ALL SELECT m.batch, 2, count(*), CAST(sum(h) AS BIGINT) FROM g2 JOIN m ON m.id = h AND m.side = 2 JOIN m n ON n.id = t AND n.side = 2 AND n.batch = m.batch GROUP BY 1", "g1", "g2", "e1", "e2", "train"))
def batch_triples(spark, d):
    t1, t2 = store(graph(spark, d, 1)), store(graph(spark, d, 2))
    a, b = _parts_of(t1, t2)
    members = store(G.batches(a, b, linked(t1, t2).filter("is_train").select("src", "trg"), 2))
    rows = G.batch_triples(t1, t2, members)
    return rows.groupBy("batch", "side").agg(F.count("*").alias("n"), F.sum("h").alias("heads"))


@query(sql(_BATCH + " SELECT batch, side, id AS old, row_number() OVER (PARTITION BY batch ORDER BY side, id) - 1 AS new FROM m", "e1", "e2", "train"))
def renumber_batches(spark, d):
    a, b = _parts(spark, d)
    return sparse.renumbered(G.batches(a, b, train(spark, d), 2))


@query(sql(", p AS (SELECT id, id % 7 AS part FROM e1 WHERE id % 3 = 0), e AS (SELECT DISTINCT least(h, t) AS u, greatest(h, t) AS v FROM g1 WHERE h <> t UNION SELECT m, id FROM (SELECT id, min(id) OVER (PARTITION BY part) AS m FROM p) WHERE m <> id) SELECT u, v, CASE WHEN a.part = b.part THEN 1000.0 ELSE 1.0 END::DOUBLE AS weight FROM e LEFT JOIN p a ON a.id = u LEFT JOIN p b ON b.id = v WHERE NOT coalesce(a.part <> b.part, false)", "g1", "e1"))
def seeded_graph(spark, d):
    t = graph(spark, d)
    groups = entities(t).filter("id % 3 = 0").withColumn("part", F.col("id") % 7)
    return G.entity_graph(t, groups)


@query(sql(", x AS (SELECT DISTINCT least(h, t) AS u, greatest(h, t) AS v FROM g1 WHERE h <> t), n AS (SELECT u, v, u AS id FROM x UNION ALL SELECT u, v, v FROM x), j AS (SELECT a.u, a.v, b.u AS x, b.v AS y, count(*) AS w FROM n a JOIN n b ON a.id = b.id AND (a.u < b.u OR (a.u = b.u AND a.v < b.v)) GROUP BY 1, 2, 3, 4) SELECT count(*) AS edges, CAST(sum(w) AS BIGINT) AS weight FROM j", "g1"))
def line_graph(spark, d):
    return G.line_graph_size(graph(spark, d))


@query(sql(", p AS (SELECT id, id % 5 AS part FROM e1), z AS (SELECT part, count(*) AS n FROM p GROUP BY 1) SELECT (SELECT count(*) FROM g1 JOIN p a ON a.id = h JOIN p b ON b.id = t WHERE a.part = b.part) AS kept, (SELECT count(*) FROM g1) AS triples, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM z", "g1", "e1"))
def part_report(spark, d):
    return rounded(G.part_report(graph(spark, d), _parts(spark, d)[0]), "mean", "deviation")


_VEC = ", x AS (SELECT id, [round(sin(id * 0.37 + i), 9) for i in range(1, 5)] AS vec FROM e1)"


def _vec(ids):
    return ids.select("id", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.round(F.sin(F.col("id") * 0.37 + i), 9)).alias("vec"))


_NORM = _BOTH + ", dg AS (SELECT src AS n, count(*) AS x FROM u GROUP BY 1), a AS (SELECT u.src, u.trg, 1 / sqrt(p.x) / sqrt(q.x) AS s FROM u JOIN dg p ON p.n = u.src JOIN dg q ON q.n = u.trg)"


@query(sql(_NORM + _VEC + " SELECT src AS id, " + ", ".join(f"round(sum(s * vec[{i}] * {w}) + 0.1, 6) AS c{i}" for i, w in ((1, 1.0), (2, 0.5), (3, 2.0), (4, -1.0))) + " FROM a JOIN x ON x.id = a.trg GROUP BY 1", "g1", "e1"))
def graph_convolution(spark, d):
    t = store(graph(spark, d))
    ids = store(entities(t))
    edges = t.select(F.col("h").alias("src"), F.col("t").alias("trg")).union(t.select("t", "h")).distinct()
    out = G.graph_convolution(sparse.from_pairs(edges), _vec(ids), [1.0, 0.5, 2.0, -1.0], [0.1] * 4, ids)
    return out.select("id", *[F.round(F.col("vec")[i - 1], 6).alias(f"c{i}") for i in range(1, 5)])


_UNIT = ", n AS (SELECT id, sqrt(list_inner_product(vec, vec)) + 1e-12 AS l, vec FROM x)"
_LAYER = ", f AS (SELECT a.src AS id, " + ", ".join(f"greatest(sum(s * vec[{i}] / l), 0) AS c{i}" for i in range(1, 5)) + " FROM a JOIN n ON n.id = a.trg GROUP BY 1)"


@query(sql(_NORM + _VEC + _UNIT + _LAYER + " SELECT a.src AS id, " + ", ".join(f"round(sum(s * c{i}), 6) AS c{i}" for i in range(1, 5)) + " FROM a JOIN f ON f.id = a.trg GROUP BY 1", "g1", "e1"))
def two_layer_convolution(spark, d):
    t = store(graph(spark, d))
    ids = store(entities(t))
    out = G.two_layer_convolution(store(G.normalized(store(G.linked_entities(t, ids)))), _vec(ids))
    return out.select("id", *[F.round(F.col("vec")[i - 1], 6).alias(f"c{i}") for i in range(1, 5)])


@query(sql(_BOTH + _VEC + """, y AS (SELECT id, [vec[1], vec[2] * 0.5, vec[3] * 2, -vec[4]] AS vec FROM x),
o AS (SELECT id, 0.3 * vec[1] - 0.2 * vec[2] + 0.1 * vec[3] AS a, 0.5 * vec[2] + 0.4 * vec[4] AS b FROM y),
s AS (SELECT src, trg, CASE WHEN p.a + q.b > 0 THEN p.a + q.b ELSE 0.2 * (p.a + q.b) END AS e FROM u JOIN o p ON p.id = src JOIN o q ON q.id = trg),
w AS (SELECT src, trg, exp(e - max(e) OVER (PARTITION BY src)) AS e FROM s), z AS (SELECT src, trg, e / sum(e) OVER (PARTITION BY src) AS p FROM w)
SELECT src AS id, """ + ", ".join(f"round(sum(p * vec[{i}]), 6) AS c{i}" for i in range(1, 5)) + " FROM z JOIN y ON y.id = z.trg GROUP BY 1", "g1", "e1"))
def graph_attention(spark, d):
    t = store(graph(spark, d))
    ids = store(entities(t))
    out = G.attention(G.linked_entities(t, ids), _vec(ids), [1.0, 0.5, 2.0, -1.0], [0.3, -0.2, 0.1, 0.0], [0.0, 0.5, 0.0, 0.4])
    return out.select("id", *[F.round(F.col("vec")[i - 1], 6).alias(f"c{i}") for i in range(1, 5)])


@query(sql("SELECT a.id, round(list_sum([1 / (1 + exp(-a.vec[i])) * b.vec[i] + (1 - 1 / (1 + exp(-a.vec[i]))) * c.vec[i] for i in range(1, 65)]), 6) AS total FROM emb a JOIN emb b ON b.id = a.id + 1 JOIN emb c ON c.id = a.id + 2", "emb"))
def highway_gate(spark, d):
    v = vectors(spark, d).select("id", "vec")
    out = G.highway(v, v.withColumn("id", F.col("id") - 1), v.withColumn("id", F.col("id") - 2))
    return out.select("id", F.round(V.total(F.col("vec")), 6).alias("total"))


@query(sql(""", t1 AS (SELECT * FROM g1), er AS (SELECT h, t, r, 1.0 / count(*) OVER (PARTITION BY h, t) AS w FROM (SELECT h, t, r FROM t1 UNION ALL SELECT t, h, r + 10 FROM t1)),
x AS (SELECT id, [greatest(round(sin(id * 0.37 + i), 9), 0) for i in range(1, 5)] AS vec FROM e1), rv AS (SELECT DISTINCT r, [round(sin(r * 0.37 + i), 9) for i in range(1, 5)] AS vec FROM er),
m AS (SELECT h, t, """ + ", ".join(f"sum(w * vec[{i}]) AS c{i}" for i in range(1, 5)) + """ FROM er JOIN rv USING (r) GROUP BY 1, 2),
k AS (SELECT h, t, [c1 / l, c2 / l, c3 / l, c4 / l] AS a FROM (SELECT *, sqrt(c1 * c1 + c2 * c2 + c3 * c3 + c4 * c4) + 1e-12 AS l FROM m)),
e AS (SELECT k.h, k.t, a, p.vec AS s, q.vec AS n, list_inner_product(q.vec, a) AS d FROM k JOIN x p ON p.id = k.h JOIN x q ON q.id = k.t),
f AS (SELECT h, t, a, s, [n[i] - 2 * d * a[i] for i in range(1, 5)] AS m FROM e),
g AS (SELECT h, m, 0.1 * s[1] + 0.2 * s[2] + 0.3 * m[1] - 0.4 * m[3] + 0.5 * a[2] AS z FROM f),
v AS (SELECT h, m, exp(z - max(z) OVER (PARTITION BY h)) AS z FROM g), u AS (SELECT h, m, z / sum(z) OVER (PARTITION BY h) AS p FROM v)
SELECT h AS id, """ + ", ".join(f"round(greatest(sum(p * m[{i}]), 0), 6) AS c{i}" for i in range(1, 5)) + " FROM u GROUP BY 1", "g1", "e1"))
def reflected_attention(spark, d):
    t = store(graph(spark, d))
    rel = G.edge_relations(t, 10)
    kernel = [0.1, 0.2, 0.0, 0.0, 0.3, 0.0, -0.4, 0.0, 0.0, 0.5, 0.0, 0.0]
    out = G.reflected_attention(rel, _vec(entities(t)), _vec(rel.select(F.col("r").alias("id")).distinct()), kernel)
    return out.select("id", *[F.round(F.col("vec")[3 + i], 6).alias(f"c{i}") for i in range(1, 5)])


_CHEBYSHEV = _VEC + """, u AS (SELECT DISTINCT h AS src, t AS trg FROM (SELECT h, t FROM g1 UNION ALL SELECT t, h FROM g1)), dg AS (SELECT src AS n, count(*) AS x FROM u GROUP BY 1),
a AS MATERIALIZED (SELECT u.src, u.trg, 1 / sqrt(p.x) / sqrt(q.x) AS s FROM u JOIN dg p ON p.n = u.src JOIN dg q ON q.n = u.trg),
y0 AS (SELECT id, vec[1] AS c1, vec[2] AS c2, vec[3] AS c3, vec[4] AS c4 FROM x)"""
for _i in (1, 2, 3):
    _sums = ", ".join(f"{-1 if _i == 1 else -2} * sum(s * c{j}) AS c{j}" for j in range(1, 5))
    _step = f"SELECT src AS id, {_sums} FROM a JOIN y{_i - 1} ON id = trg GROUP BY 1"
    if _i > 1:
        _step = "SELECT n.id, " + ", ".join(f"n.c{j} - o.c{j} AS c{j}" for j in range(1, 5)) + f" FROM ({_step}) n JOIN y{_i - 2} o ON o.id = n.id"
    _CHEBYSHEV += f", y{_i} AS MATERIALIZED ({_step})"


@query(sql(_CHEBYSHEV + " SELECT id, " + ", ".join(f"round(c{j}, 6) AS c{j}" for j in range(1, 5)) + " FROM y3", "g1", "e1"))
def chebyshev(spark, d):
    """The third polynomial times the vectors of all entities. Parts and nations are one side of the graph, the others the other side."""
    t = store(graph(spark, d))
    ids = store(entities(t))
    edges = store(t.select(F.col("h").alias("src"), F.col("t").alias("trg")).union(t.select("t", "h")).distinct())
    out = G.chebyshev_features(sparse.from_pairs(edges), ids, _vec(ids), 3, largest=2.0)[3]
    return out.select("id", *[F.round(F.col("vec")[i - 1], 6).alias(f"c{i}") for i in range(1, 5)])


@query()
def random_parts(spark, d):
    return G.random_parts(entities(graph(spark, d)), 5).groupBy("part").agg(F.count("*").alias("n"))


@query()
def label_parts(spark, d):
    t = store(graph(spark, d))
    return G.label_parts(G.entity_graph(t), entities(t), 5).groupBy("part").agg(F.count("*").alias("n"))


@query(sql(", x AS (SELECT src, trg FROM train) SELECT count(DISTINCT src) AS pairs FROM x", "train"))
def pair_negatives(spark, d):
    """Every pair keeps wrong ends, and none of them is the right one."""
    t1, t2 = store(graph(spark, d, 1)), store(graph(spark, d, 2))
    pairs = store(linked(t1, t2).filter("is_train").select("src", "trg"))
    e1, e2 = store(entities(t1)), store(entities(t2))
    bad = match.random_pair_negatives(pairs, e1, e2, 5)
    return bad.filter("src <> src2 or trg <> trg2").agg(F.count_distinct("src").alias("pairs"))


@query(sql(", x AS (SELECT * FROM g1 WHERE r = 3) SELECT count(*) AS true_ones FROM x WHERE false", "g1"))
def triple_negatives(spark, d):
    """No corrupted triple is a true one."""
    t = store(graph(spark, d))
    bad = match.random_triple_negatives(t, entities(t), 3).select(F.col("h2").alias("h"), "r", F.col("t2").alias("t"))
    return bad.join(t, ["h", "r", "t"], "left_semi").agg(F.count("*").alias("true_ones"))


@query(sql(", x AS (SELECT * FROM g1 WHERE r = 4), n AS (SELECT DISTINCT h FROM x) SELECT 0 AS foreign_ends, count(*) > 0 AS any FROM n", "g1"))
def typed_negatives(spark, d):
    """Replaced ends come from the same place of the same relation."""
    x = store(graph(spark, d))
    bad = match.random_triple_negatives(x, entities(x), 3, typed=True)
    foreign = bad.join(x.select("r", F.col("h").alias("h2")), ["r", "h2"], "left_anti").count() + bad.join(x.select("r", F.col("t").alias("t2")), ["r", "t2"], "left_anti").count()
    return bad.agg(F.lit(foreign).cast("int").alias("foreign_ends"), (F.count("*") > 0).alias("any"))
