"""Readers, writers and layouts of graph files, and operators beside them: queries and their SQL.

The files are written from the tables to the shared folder first, so each query is a whole round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmap.functions import text as T
from kinmap.functions import vectors as V
from kinmap.operators import match, sparse, tokens
from kinmap.operators import graph as G
from kinmap.operators.knn import nearest
from kinmap.operators.low_rank import flipped, low_rank
from kinmap.operators.storage import shared_path
from kinmap.plans.fixture import cells, entities, every_cell, graph, links, rounded, sql, table, vectors
from kinmap.sources import graphs as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return put


def lines(df, path: str, *order: str, sep: str = "\t") -> None:
    """One sorted text file: the place of a line matters to its readers."""
    rows = df.repartition(1).sortWithinPartitions(*order)
    rows.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns if c != "_order"]).alias("value")).write.text(path)


def _files(spark, d, names=("rel_triples_1", "triples_2", "ent_links")) -> str:
    path = shared_path(spark)
    for i, name in enumerate(names[:2], 1):
        t = graph(spark, d, i)
        uri = lambda c: F.concat(F.lit("http://a.org/r/e"), F.col(c))
        lines(t.select(uri("h").alias("s"), F.concat(F.lit("rel"), F.col("r")).alias("p"), uri("t").alias("o"), (F.col("h") * 1000 + F.col("r")).alias("_order")), f"{path}/{name}", "_order", "o")
    uri = lambda c: F.concat(F.lit("http://a.org/r/e"), c)
    known = links(spark, d).select(uri(F.col("src")).alias("s"), uri(F.col("trg")).alias("t"), F.col("src").alias("_order"))
    late = table(spark, d, "region").select(F.concat(F.lit("late"), "r_regionkey").alias("s"), F.concat(F.lit("spät"), "r_regionkey").alias("t"), (F.col("r_regionkey") + F.lit(1 << 40)).alias("_order"))
    lines(known.union(late), f"{path}/{names[2]}", "_order")
    return path


def _side(i: int, col: str) -> str:
    return f"""
l{i} AS (SELECT 'http://a.org/r/e' || h AS s, 'rel' || r AS p, 'http://a.org/r/e' || t AS o, row_number() OVER (ORDER BY h * 1000 + r, 'http://a.org/r/e' || t) AS pos FROM g{i}),
f{i} AS (SELECT k, min(pos) AS pos FROM (SELECT s AS k, 2 * pos AS pos FROM l{i} UNION ALL SELECT o, 2 * pos + 1 FROM l{i}) GROUP BY 1),
n{i} AS (SELECT k, row_number() OVER (ORDER BY pos) - 1 AS id FROM f{i}),
late{i} AS (SELECT {col} AS k, (SELECT count(*) FROM n{i}) + row_number() OVER (ORDER BY min(pos)) - 1 AS id FROM ln WHERE {col} NOT IN (SELECT k FROM n{i}) GROUP BY 1),
ent{i} AS (SELECT * FROM n{i} UNION ALL SELECT * FROM late{i}),
rel{i} AS (SELECT p, row_number() OVER (ORDER BY min(pos)) - 1 AS id FROM l{i} GROUP BY 1),
t{i} AS (SELECT a.id AS h, rel{i}.id AS r, b.id AS t FROM l{i} JOIN ent{i} a ON a.k = s JOIN ent{i} b ON b.k = o JOIN rel{i} USING (p))"""


_DATA = (
    """, lk AS (SELECT 'http://a.org/r/e' || src AS s, 'http://a.org/r/e' || trg AS t, src AS o FROM link UNION ALL SELECT 'late' || r_regionkey, 'spät' || r_regionkey, r_regionkey + (1::BIGINT << 40) FROM region),
ln AS (SELECT s, t, row_number() OVER (ORDER BY o) AS pos FROM lk),"""
    + _side(1, "s")
    + ","
    + _side(2, "t")
    + """,
pairs AS (SELECT pos, ent1.id AS src, ent2.id AS trg, pos - 1 < CAST(floor(0.2 * (SELECT count(*) FROM ln)) AS BIGINT) AS is_train FROM ln JOIN ent1 ON ent1.k = s JOIN ent2 ON ent2.k = ln.t)
"""
)
_NEEDED = ("g1", "g2", "e1", "e2", "link")


def _rows(what: str, df):
    return df.select(F.lit(what).alias("what"), *[F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(df.columns)])


@query(sql(_DATA + "SELECT 't1' AS what, h AS c0, r AS c1, t AS c2 FROM t1 UNION ALL SELECT 't2', h, r, t FROM t2 UNION ALL SELECT 'link', src, trg, CAST(is_train AS BIGINT) FROM pairs", *_NEEDED))
def paired_layout_files(spark, d):
    """Text files of two graphs and their links, numbered by first appearance; late entities are only in the links."""
    data = S.paired_layout(spark, _files(spark, d))
    return _rows("t1", data.triples1).union(_rows("t2", data.triples2)).union(_rows("link", data.links.select("src", "trg", "is_train")))


@query(sql(_DATA + "SELECT (SELECT count(*) FROM ln) AS test, CAST(0 AS BIGINT) AS train, (SELECT count(*) FROM ent1) AS entities1, (SELECT count(*) FROM ent2) AS entities2, (SELECT count(*) FROM rel1) AS relations1, (SELECT count(*) FROM t2) AS triples2", *_NEEDED))
def large_layout_files(spark, d):
    """The layout with a language in the names, unsupervised: all links are for testing."""
    path = _files(spark, d, ("fr_triples_strict_1", "fr_triples_strict_2", "fr_ent_links"))
    data = S.large_layout(spark, path, "fr", strict=True, unsupervised=True)
    sizes = {"test": data.test, "train": data.train, "entities1": data.entity1, "entities2": data.entity2, "relations1": data.relation1, "triples2": data.triples2}
    row = [df.agg(F.count("*").alias(n)) for n, df in sizes.items()]
    out = row[0]
    for r in row[1:]:
        out = out.crossJoin(r)  # one row each
    return out


@query(sql(_DATA + """, z AS (SELECT (SELECT count(*) FROM ent1) AS n, (SELECT count(*) FROM rel1) AS m)
SELECT 't1' AS what, h AS c0, r + 1 AS c1, t AS c2 FROM t1 UNION ALL SELECT 't2', h + n, r + m + 1, t + n FROM t2, z UNION ALL SELECT 'pair', src, trg + n, 0 FROM pairs, z UNION ALL SELECT 'name', id, len(k), 0 FROM ent1 UNION ALL SELECT 'name', id + n, len(k), 0 FROM ent2, z""", *_NEEDED))
def exported_files(spark, d):
    """Both graphs written in one number space and read back as encoded files."""
    data, path = S.paired_layout(spark, _files(spark, d)), shared_path(spark)
    S.export_pair(data, path)
    back = S.encoded_layout(spark, path)
    out = _rows("t1", back["triples1"].select("h", "r", "t")).union(_rows("t2", back["triples2"].select("h", "r", "t")))
    pairs, names = back["test"].select("src", "trg", F.lit(0).alias("z")), back["names"].select("id", F.length("name").alias("n"), F.lit(0).alias("z"))
    return out.union(_rows("pair", pairs)).union(_rows("name", names))


@query(sql(_DATA + "SELECT 'train' AS what, src, trg FROM pairs WHERE is_train UNION ALL SELECT 'train', 1, 2 UNION ALL SELECT 'test', src, trg FROM pairs WHERE NOT is_train", *_NEEDED))
def saved_dataset(spark, d):
    """A dataset with a pseudo-link, saved and loaded."""
    data, path = S.paired_layout(spark, _files(spark, d)), shared_path(spark)
    data.pseudo = spark.createDataFrame([(1, 2)], "src long, trg long")
    data.save(path)
    back = S.Dataset.load(spark, path)
    return back.train.select(F.lit("train").alias("what"), "src", "trg").union(back.test.select(F.lit("test"), "src", "trg"))


@query("SELECT c_custkey || ';' || c_name AS value FROM customer UNION ALL SELECT CAST(count(*) AS VARCHAR) FROM customer")
def sorted_lines(spark, d):
    """Sorted lines under a header that counts them."""
    path = shared_path(spark)
    S.write_delimited(table(spark, d, "customer").select("c_custkey", "c_name"), path, [F.desc("c_custkey")], ";", count=True)
    return spark.read.text(path)


@query("SELECT n_nationkey * 2 + 7 AS id, n_name AS key FROM nation WHERE n_nationkey % 3 <> 0")
def dictionary_file(spark, d):
    """A dictionary written by number, read back and renumbered."""
    path, n = shared_path(spark), table(spark, d, "nation")
    S.write_dictionary(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("key")), path)
    back = S.read_names(spark, [path]).withColumnRenamed("name", "key")
    new = n.filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") * 2 + 7).alias("new"))
    return S.keys_in_order(back, new)


@query(sql(", w AS (SELECT 'w' || id AS word, round(list_sum([round(x, 4) for x in vec]), 4) AS total FROM emb) SELECT CASE WHEN id % 2 = 0 THEN '#W' ELSE 'zz' END || id AS word, CASE WHEN id % 2 = 0 THEN w.total ELSE NULL END AS total FROM emb JOIN w ON w.word = 'w' || id", "emb"))
def word_vector_files(spark, d):
    """Vectors as lines of text with four decimals, looked up by words; the file has no line for unknown words."""
    path, v = shared_path(spark), vectors(spark, d)
    S.write_vectors(v.select(F.concat(F.lit("w"), "id").alias("word"), "vec"), path)
    words = v.select(F.concat(F.when(F.col("id") % 2 == 0, "#W").otherwise("zz"), "id").alias("word"))
    return S.look_up_vectors(words, S.read_vectors(spark, path, 64)).select("word", F.round(V.total(F.col("vec")), 4).alias("total"))


@query(sql("SELECT src, trg, round(sum(score), 6) AS score FROM (SELECT src, trg, score FROM cells UNION ALL SELECT src, trg, 0.05 * score FROM cells WHERE trg % 2 = 0) GROUP BY 1, 2", "cells"))
def phase_files(spark, d):
    """Similarity tables saved by phase, loaded and fused; a phase that was not saved is skipped."""
    path, c = shared_path(spark), cells(spark, d)
    S.save_similarity(c, path, 2, "small", "fr")
    S.save_similarity(c.filter("trg % 2 = 0"), path, 3, "small", "fr")
    return rounded(sparse.fuse(S.load_similarities(spark, path, [2, 3, 5], "small", "fr"), [1.0, 0.05, 1.0]))


@query("SELECT l_orderkey AS h, l_linenumber + CAST(1 AS BIGINT) AS r, l_partkey AS t, l_partkey AS c1 FROM lineitem")
def encoded_files(spark, d):
    """Integers between blanks: triples with shifted relations, and columns of the same file."""
    path = shared_path(spark)
    S.write_delimited(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), path, sep="  ")
    a = S.read_encoded_triples(spark, path).select("pos", "h", "r", "t")
    return a.join(S.read_columns(spark, path, 3).select("pos", F.col("c2").alias("c1")), "pos").drop("pos")


@query("SELECT c_name AS entity, c_mktsegment AS attribute FROM customer UNION ALL SELECT c_name, 'n' || c_nationkey FROM customer WHERE c_custkey % 2 = 0")
def attribute_files(spark, d):
    """Ragged lines of an entity and its attributes."""
    path, c = shared_path(spark), table(spark, d, "customer")
    more = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("n"), "c_nationkey"))
    c.select(F.concat_ws("\t", "c_name", "c_mktsegment", more).alias("value")).write.text(path)
    return S.read_attributes(spark, [path])


@query("SELECT CAST(count(*) AS VARCHAR) AS rows, name FROM (SELECT 'region' AS name FROM region UNION ALL SELECT 'nation' FROM nation) GROUP BY name")
def result_log(spark, d):
    """Results appended to a log, one row a run."""
    path = shared_path(spark)
    for name in ("region", "nation"):
        S.log_metrics(spark, path, name=name, rows=table(spark, d, name).count())
    return spark.read.json(path).select("rows", "name")


@query("SELECT CAST(to_json({'r_regionkey': r_regionkey, 'r_name': r_name}) AS VARCHAR) AS value FROM region")
def json_rows(spark, d):
    return S.as_json(table(spark, d, "region").select("r_regionkey", "r_name"))


@query("SELECT CAST(0 AS BIGINT) AS lines")
def empty_file(spark, d):
    path = shared_path(spark)
    S.write_empty(spark, path)
    return spark.read.text(path).agg(F.count("*").alias("lines"))


@query(sql(", m AS (SELECT ent, pos, w[pos + 1] AS token FROM (SELECT p_partkey AS ent, string_split(p_name, ' ') AS w, unnest(range(0, len(string_split(p_name, ' ')))) AS pos FROM part)), x AS (SELECT m.*, e.vec FROM m JOIN emb e ON e.id = (m.ent * 7 + m.pos) % (SELECT count(*) FROM emb)), c AS (SELECT token, i, avg(vec[i]) AS a FROM (SELECT token, vec, unnest(range(1, 65)) AS i FROM x) GROUP BY 1, 2) SELECT token, (SELECT count(DISTINCT ent) FROM m WHERE m.token = c.token) AS ents, (SELECT min(ent) FROM m WHERE m.token = c.token) AS first, round(sum(a), 5) AS total, round(max(a), 5) AS top FROM c GROUP BY token", "emb"))
def token_index(spark, d):
    """For each token of part names the parts that hold it and the mean of its vectors there."""
    m = table(spark, d, "part").select(F.col("p_partkey").alias("ent"), F.posexplode(F.split("p_name", " ")).alias("pos", "token"))
    v = vectors(spark, d).select("id", "vec")
    n = max(1, v.count())
    x = m.select("ent", "pos", ((F.col("ent") * 7 + F.col("pos")) % n).alias("id")).join(v, "id").select("ent", "pos", "vec")
    return tokens.token_index(m, x).select("token", F.size("ents").cast("long").alias("ents"), F.col("ents")[0].alias("first"), F.round(V.total(F.col("vec")), 5).alias("total"), F.round(F.array_max("vec"), 5).alias("top"))


@query("WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')[1:382] AS w FROM documents) SELECT doc_id, CAST(len(w) AS INTEGER) AS n, w[1] AS first, w[len(w)] AS last, CAST(400 AS INTEGER) AS padded FROM w")
def cut_and_padded_tokens(spark, d):
    t = T.cut_tokens(T.tokens(F.col("text")))
    rows = table(spark, d, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.try_element_at("t", F.lit(1)).alias("first"), F.try_element_at("t", F.lit(-1)).alias("last"), F.size(T.padded_tokens(F.col("t"), F.lit(400))).alias("padded"))


@query(sql(", x AS (SELECT a.id, [a.vec, b.vec, c.vec][1:a.id % 4] AS v FROM emb a JOIN emb b ON b.id = (a.id * 3 + 1) % (SELECT count(*) FROM emb) JOIN emb c ON c.id = (a.id * 5 + 2) % (SELECT count(*) FROM emb)) SELECT id, CASE WHEN len(v) > 0 THEN round(list_sum([list_max([w[i] for w in v]) for i in range(1, 65)]), 5) END AS top, CASE WHEN len(v) > 0 THEN round(list_sum([list_avg([w[i] for w in v]) for i in range(1, 65)]), 5) END AS mean FROM x", "emb"))
def masked_pooling(spark, d):
    """Up to three of three vectors; the rest is padding."""
    v = vectors(spark, d).select("id", "vec")
    n = max(1, v.count())
    x = v.withColumn("_b", (F.col("id") * 3 + 1) % n).withColumn("_c", (F.col("id") * 5 + 2) % n)
    x = x.join(v.select(F.col("id").alias("_b"), F.col("vec").alias("b")), "_b").join(v.select(F.col("id").alias("_c"), F.col("vec").alias("c")), "_c")
    x = x.select("id", F.array("vec", "b", "c").alias("v"), (F.col("id") % 4).cast("int").alias("n"))
    made = x.select("id", V.masked_pool(F.col("v"), F.col("n"), "max").alias("a"), V.masked_pool(F.col("v"), F.col("n"), "mean").alias("m"))
    return made.select("id", F.round(V.total(F.col("a")), 5).alias("top"), F.round(V.total(F.col("m")), 5).alias("mean"))


@query("""WITH a AS (SELECT l_suppkey AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_quantity) / 100 AS x FROM lineitem GROUP BY 1, 2), m AS (SELECT CAST(l_linenumber AS BIGINT) AS j, CAST(l_quantity AS BIGINT) % 20 AS k, count(*) / 100.0::DOUBLE AS x FROM lineitem GROUP BY 1, 2),
p AS (SELECT a.i, m.k, sum(a.x * m.x) AS x FROM a JOIN m USING (j) GROUP BY 1, 2) SELECT p.i AS src, q.i AS trg, round(sum(p.x * q.x) / 1000, 3) AS score FROM p JOIN p q USING (k) GROUP BY 1, 2""")
def low_rank_similarity(spark, d):
    """A product of rank seven at most, decomposed at rank ten: nothing is lost. Suppliers against suppliers over line numbers and quantities."""
    li = table(spark, d, "lineitem").withColumn("j", F.col("l_linenumber").cast("long")).withColumn("k", F.col("l_quantity").cast("long") % 20)
    a = li.groupBy(F.col("l_suppkey").alias("src"), F.col("j").alias("trg")).agg((F.sum("l_quantity") / 100).alias("score"))
    m = li.groupBy(F.col("j").alias("src"), F.col("k").alias("trg")).agg((F.count("*") / 100).alias("score"))
    return low_rank(a, m, flipped(sparse.product(a, m)), rank=10, keep=20).withColumn("score", F.round(F.col("score") / 1000, 3))


@query(sql(", c AS (SELECT va.id AS src, vb.id AS trg, 0.7 * list_cosine_similarity(va.vec, vb.vec) + 0.3 * list_cosine_similarity(va.vec[1:32], vb.vec[1:32]) AS score FROM va, vb) SELECT src, trg, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, trg) AS n FROM c) WHERE n <= 5", "va", "vb"))
def weighted_concat_neighbours(spark, d):
    """Neighbours by two embeddings joined with weights."""
    both = lambda df: df.select("id", V.weighted_concat([(F.col("vec"), 0.7), (F.slice("vec", 1, 32), 0.3)]).alias("vec"))
    return rounded(nearest(both(vectors(spark, d, 0)), both(vectors(spark, d, 1)), 5, "inner"))


_THREE = "a.vec AS e, b.vec AS r, c.vec AS t FROM emb a JOIN emb b ON b.id = (a.id * 7 + 1) % (SELECT count(*) FROM emb) JOIN emb c ON c.id = (a.id * 3 + 2) % (SELECT count(*) FROM emb)"


def _three(spark, d):
    v = vectors(spark, d).select("id", "vec")
    n = max(1, v.count())
    two = lambda c: F.slice(c, 1, 2)
    x = v.withColumn("_r", (F.col("id") * 7 + 1) % n).withColumn("_t", (F.col("id") * 3 + 2) % n)
    x = x.join(v.select(F.col("id").alias("_r"), F.col("vec").alias("r")), "_r").join(v.select(F.col("id").alias("_t"), F.col("vec").alias("t")), "_t")
    return x.select("id", two("vec").alias("e"), two("r").alias("r"), two("t").alias("t"))


@query(sql(f""", x AS (SELECT a.id, {_THREE}), h AS (SELECT *, tanh(e[1] + 2 * t[1] + 0.1) AS u, tanh(e[2] - t[2] - 0.2) AS v FROM x), k AS (SELECT *, u / (sqrt(u * u + v * v) + 1e-12) AS p, v / (sqrt(u * u + v * v) + 1e-12) AS q FROM h),
s AS (SELECT *, tanh(r[1] - (r[1] * p + r[2] * q) * p) AS y, tanh(r[2] - (r[1] * p + r[2] * q) * q) AS z FROM k) SELECT id, round(sqrt((e[1] + y - t[1]) ** 2 + (e[2] + z - t[2]) ** 2), 6) AS score FROM s""", "emb"))
def transedge_ends_score(spark, d):
    """The relation projected by a context made of both ends."""
    s = V.edge_translate_by_ends(F.col("e"), F.col("r"), F.col("t"), [[1.0, 0.0, 2.0, 0.0], [0.0, 1.0, 0.0, -1.0]], [0.1, -0.2])
    return _three(spark, d).select("id", F.round(s, 6).alias("score"))


@query(sql(f""", x AS (SELECT a.id, {_THREE}), l AS (SELECT *, tanh(e[1] + r[2]) AS a1, tanh(e[2] - r[1]) AS a2, tanh(r[1] + t[1]) AS b1, tanh(2 * t[2]) AS b2 FROM x),
n AS (SELECT *, a1 / (sqrt(a1 * a1 + a2 * a2) + 1e-12) AS c1, a2 / (sqrt(a1 * a1 + a2 * a2) + 1e-12) AS c2, b1 / (sqrt(b1 * b1 + b2 * b2) + 1e-12) AS c3, b2 / (sqrt(b1 * b1 + b2 * b2) + 1e-12) AS c4 FROM l),
m AS (SELECT *, sqrt(c1 * c1 + c2 * c2 + c3 * c3 + c4 * c4) + 1e-12 AS g FROM n), o AS (SELECT *, tanh((c1 + c3) / g) AS y, tanh((c2 - c4) / g + 0.3) AS z FROM m), p AS (SELECT *, tanh(y / (sqrt(y * y + z * z) + 1e-12)) AS u, tanh(z / (sqrt(y * y + z * z) + 1e-12)) AS v FROM o)
SELECT id, round(sqrt((e[1] + u - t[1]) ** 2 + (e[2] + v - t[2]) ** 2), 6) AS score FROM p""", "emb"))
def transedge_edges_score(spark, d):
    """The relation replaced by a context of its compressed edges."""
    layers = [([[1.0, 0.0, 1.0, 0.0], [0.0, 1.0, 0.0, -1.0]], [0.0, 0.3]), ([[1.0, 0.0, 0.0, 1.0], [0.0, 1.0, -1.0, 0.0]], [0.0, 0.0]), ([[1.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 2.0]], [0.0, 0.0])]
    return _three(spark, d).select("id", F.round(V.edge_translate_by_edges(F.col("e"), F.col("r"), F.col("t"), layers), 6).alias("score"))


@query(sql("SELECT CASE WHEN score >= -0.5 THEN 'least' ELSE 'below' END AS what, src, trg FROM cell", "cell"))
def threshold_sides(spark, d):
    what = F.when(match.is_above(-0.5, equal=True), F.lit("least")).when(match.is_above(-0.5, greater=False), F.lit("below"))
    return every_cell(spark, d).select(what.alias("what"), "src", "trg").filter("what is not null")


@query(sql("SELECT r, count(*) * 2 AS negatives, CAST(0 AS BIGINT) AS true_ones FROM g1 GROUP BY r", "g1"))
def widened_negatives(spark, d):
    """Every triple has two wrong ones, also where the relation's own ends give none: they are drawn again from all nodes."""
    t = graph(spark, d)
    bad = match.widened_triple_negatives(t, entities(t), 2).withColumnRenamed("h", "_h").withColumnRenamed("t", "_t")
    true = t.select(F.col("h").alias("h2"), "r", F.col("t").alias("t2"), F.lit(1).alias("true"))
    return bad.join(true, ["h2", "r", "t2"], "left").groupBy("r").agg(F.count("*").alias("negatives"), F.count("true").alias("true_ones"))


@query()
def edge_parts(spark, d):
    """The edges between suppliers, nations and regions in balanced parts (nation hubs make lines quadratic)."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    own = s.select(F.col("s_suppkey").alias("h"), (F.col("s_nationkey") + 1_000_000).cast("long").alias("t")).union(n.select((F.col("n_nationkey") + 1_000_000).cast("long"), (F.col("n_regionkey") + 2_000_000).cast("long")))
    return G.edge_parts(own, 4).groupBy("part").agg(F.count("*").alias("n"))
