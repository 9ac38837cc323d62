"""Training, partition batches and the whole alignment: queries. Random and iterative, so most have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmap.operators import graph as G
from kinmap.operators import train
from kinmap.operators.storage import store
from kinmap.plans.fixture import entities, graph, linked
from kinmap.plans.fixture import train as train_links
from kinmap.plans.pipeline import Config, EntityAlignment

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _batches(spark, d, k=4):
    t1, t2 = store(graph(spark, d, 1)), store(graph(spark, d, 2))
    a = entities(t1).withColumn("part", (F.col("id") % k).cast("int"))
    b = entities(t2).withColumn("part", (F.col("id") % k).cast("int"))
    pairs = store(linked(t1, t2).filter("is_train").select("src", "trg"))
    members = store(G.batches(a, b, pairs))
    return members, G.batch_triples(t1, t2, members)


def _trained(spark, d, model, **options):
    members, triples = _batches(spark, d)
    vectors = train.train_batches(members, triples, train_links(spark, d), model, **options)
    return train.batch_similarity(vectors, 10)


@query
def gcn_train(spark, d):
    return _trained(spark, d, "gcn-align", epochs=20, dim=32)


@query
def rrea_train(spark, d):
    return _trained(spark, d, "rrea", epochs=5, dim=16, rounds=2)


@query
def mtranse_train(spark, d):
    return _trained(spark, d, "mtranse")


@query
def rotate_train(spark, d):
    return _trained(spark, d, "rotate")


def alignment(spark, d, **options) -> EntityAlignment:
    t1, t2 = store(graph(spark, d, 1)), store(graph(spark, d, 2))
    # names of both sides differ in their prefix and in a letter of every seventh
    uri = lambda host, twist: F.concat(F.lit(f"http://{host}.example.org/resource/"), F.when(F.col("id") >= 10_000_000, F.lit("Thing_")).otherwise(F.lit("Thing_")), F.regexp_replace(F.substring(F.sha1((F.col("id") % 10_000_000).cast("string")), 1, 12), "([0-9a-f]{4})", "$1_"), F.when(F.col("id") % 7 == twist, F.lit("x")).otherwise(F.lit("")))
    n1 = entities(t1).select("id", uri("en", 1).alias("uri"))
    n2 = entities(t2).select("id", uri("fr", 3).alias("uri"))
    pairs = store(linked(t1, t2))
    return EntityAlignment(spark, t1, t2, n1, n2, pairs.filter("is_train").select("src", "trg"), pairs.filter("not is_train").select("src", "trg"), Config(**options))


@query
def entity_alignment(spark, d):
    return alignment(spark, d, parts=4, epochs=5, dim=16, model="gcn-align").scores()
