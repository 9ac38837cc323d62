"""Graphs as (h, r, t) rows: statistics, adjacency, alignment-driven triples, message passing, partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinmap.functions import vectors as V
from kinmap.operators import sparse
from kinmap.operators.storage import store


def functionality(triples: DataFrame) -> DataFrame:
    """Each relation's distinct heads and distinct tails, over its triples."""
    n = F.count("*")
    return triples.groupBy("r").agg((F.count_distinct("h") / n).alias("func"), (F.count_distinct("t") / n).alias("inverse"))


def weighted_adjacency(triples: DataFrame, least: float = 0.3) -> DataFrame:
    """(src, trg, score): each triple that is no loop adds its relation's inverse functionality to (tail, head) and
    its functionality to (head, tail), ``least`` at least. The table of relations is small beside the triples but not bounded: it is
    stored, so that Spark knows its size when it plans, and does not gather a relation's triples in one task if it is small."""
    weighed = triples.filter("h <> t").join(store(functionality(triples)), "r")
    both = F.array(
        F.struct(F.col("t").alias("src"), F.col("h").alias("trg"), F.greatest("inverse", F.lit(least)).alias("score")),
        F.struct(F.col("h").alias("src"), F.col("t").alias("trg"), F.greatest("func", F.lit(least)).alias("score")),
    )
    return sparse.coalesced(weighed.select(F.explode(both).alias("e")).select("e.*"))


def normalized(adj: DataFrame) -> DataFrame:
    """D^-1/2 A D^-1/2 by row sums; rows of sum 0 get weight 0."""
    cells = sparse.coalesced(adj)
    total = cells.groupBy(F.col("src").alias("_n")).agg(F.sum("score").alias("_d"))
    weight = total.select("_n", F.when(F.col("_d") > 0, 1 / F.sqrt("_d")).otherwise(F.lit(0.0)).alias("_w"))
    a = weight.withColumnRenamed("_n", "src").withColumnRenamed("_w", "_a")
    b = weight.withColumnRenamed("_n", "trg").withColumnRenamed("_w", "_b")
    return cells.join(a, "src").join(b, "trg", "left").select("src", "trg", (F.col("score") * F.col("_a") * F.coalesce("_b", F.lit(0.0))).alias("score"))


def edge_counts(triples: DataFrame) -> DataFrame:
    """How many triples each (h, t) has."""
    return triples.groupBy("h", "t").agg(F.count("*").alias("n"))


def relation_features(triples: DataFrame) -> DataFrame:
    """(id, r, way, n): how often an entity is head ("out") or tail ("in") of a relation."""
    out = triples.select(F.col("h").alias("id"), "r", F.lit("out").alias("way"))
    into = triples.select(F.col("t").alias("id"), "r", F.lit("in").alias("way"))
    return out.unionByName(into).groupBy("id", "r", "way").agg(F.count("*").alias("n"))


def linked_entities(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Binary symmetric adjacency with a loop at every entity (id)."""
    both = triples.select(F.col("h").alias("src"), F.col("t").alias("trg")).union(triples.select("t", "h"))
    return sparse.from_pairs(both.union(entities.select("id", F.col("id"))).distinct())


def edge_relations(triples: DataFrame, relations: int) -> DataFrame:
    """(h, t, r, w): for each direction of each edge its relations, the reverse ones numbered after the others,
    weighted by one over the edge's number of them."""
    both = triples.select("h", "t", "r").union(triples.select("t", "h", F.col("r") + F.lit(relations)))
    return both.withColumn("w", 1 / F.count("*").over(W.partitionBy("h", "t")))


def multi_edges(triples: DataFrame, entities: DataFrame | None = None, with_relations: bool = False) -> DataFrame:
    """Edges in both directions without loops: with relations one row for each triple and direction, else one
    row for each ordered pair, and a loop for each entity (id)."""
    real = triples.filter("h <> t")
    both = real.select("h", "t", F.abs("r").alias("r")).union(real.select("t", "h", F.abs("r")))
    if with_relations:
        return both
    pairs = both.select("h", "t").distinct()
    return pairs.union(entities.select("id", F.col("id"))) if entities is not None else pairs


def neighbour_sets(triples: DataFrame) -> DataFrame:
    """(id, near): sorted distinct neighbours, either way, without the entity."""
    real = triples.filter("h <> t")
    both = real.select(F.col("h").alias("id"), F.col("t").alias("n")).union(real.select("t", "h"))
    return both.groupBy("id").agg(F.sort_array(F.collect_set("n")).alias("near"))


def top_attributes(rows: DataFrame, k: int = 2000) -> DataFrame:
    """(id, attribute) -> distinct rows of the k most frequent attributes (ties by name)."""
    best = rows.groupBy("attribute").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "attribute").limit(k)
    return rows.join(F.broadcast(best.select("attribute")), "attribute", "left_semi").select("id", "attribute").distinct()


# Triples by links between the graphs: (src, trg) rows.


def _map(links: DataFrame, key: str, value: str, a: str = "src", b: str = "trg") -> DataFrame:
    return links.select(F.col(a).alias(key), F.col(b).alias(value))


def shared_triples(source: DataFrame, target: DataFrame, links: DataFrame) -> DataFrame:
    """The target's triples, and the source's with both ends linked, in the target's terms."""
    moved = source.join(_map(links, "h", "_h"), "h").join(_map(links, "t", "_t"), "t").select(F.col("_h").alias("h"), "r", F.col("_t").alias("t"))
    return target.select("h", "r", "t").unionAll(moved)


def substituted(triples: DataFrame, links: DataFrame) -> DataFrame:
    """Linked source entities replaced by their targets; distinct."""
    moved = triples.join(_map(links, "h", "_h"), "h", "left").join(_map(links, "t", "_t"), "t", "left")
    return moved.select(F.coalesce("_h", "h").alias("h"), "r", F.coalesce("_t", "t").alias("t")).distinct()


def swapped(triples: DataFrame, links: DataFrame) -> DataFrame:
    """The triples, and each with one linked end replaced by its counterpart, either way; distinct."""
    both = links.select("src", "trg").union(links.select("trg", "src")).toDF("a", "b").distinct()
    by_head = triples.join(both, F.col("h") == F.col("a")).select(F.col("b").alias("h"), "r", "t")
    by_tail = triples.join(both, F.col("t") == F.col("a")).select("h", "r", F.col("b").alias("t"))
    return triples.select("h", "r", "t").union(by_head).union(by_tail).distinct()


def boot_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each new pair, either side's triples with the other side in its place; distinct."""
    both = pairs.select("src", "trg").union(pairs.select("trg", "src")).toDF("a", "b").distinct()
    by_head = triples.join(both, F.col("h") == F.col("a")).select(F.col("b").alias("h"), "r", "t")
    by_tail = triples.join(both, F.col("t") == F.col("a")).select("h", "r", F.col("b").alias("t"))
    return by_head.union(by_tail).distinct()


# Message passing: edges (src, trg, score), vectors (id, vec).


def graph_convolution(adj: DataFrame, vectors: DataFrame, diagonal: list[float] | None = None, bias: list[float] | None = None, loops: DataFrame | None = None, activate: bool = False) -> DataFrame:
    """normalized(A [+ I]) times the vectors, which a diagonal weight scales first."""
    edges = adj if loops is None else adj.unionByName(sparse.from_pairs(loops.select(F.col("id").alias("src"), F.col("id").alias("trg"))))
    x = vectors
    if diagonal is not None:
        x = x.withColumn("vec", V.times(F.col("vec"), F.array(*map(F.lit, diagonal))))
    out = sparse.product_with_dense(normalized(edges), x)
    if bias is not None:
        out = out.withColumn("vec", V.plus(F.col("vec"), F.array(*map(F.lit, bias))))
    return out.withColumn("vec", relu(F.col("vec"))) if activate else out


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def two_layer_convolution(adj: DataFrame, vectors: DataFrame) -> DataFrame:
    """A relu(A unit(x)) for an adjacency that is normalised already."""
    first = store(sparse.product_with_dense(adj, vectors.withColumn("vec", V.unit(F.col("vec"), 1e-12))))
    return sparse.product_with_dense(adj, first.withColumn("vec", relu(F.col("vec"))))


def attention(edges: DataFrame, vectors: DataFrame, diagonal: list[float], self_weight: list[float], near_weight: list[float], slope: float = 0.2) -> DataFrame:
    """One head of graph attention with a diagonal weight: leaky-relu scores of both ends, softmax over each entity's edges."""
    x = vectors.withColumn("vec", V.times(F.col("vec"), F.array(*map(F.lit, diagonal))))
    own = x.select(F.col("id").alias("src"), V.dot(F.col("vec"), F.array(*map(F.lit, self_weight))).alias("_a"))
    near = x.select(F.col("id").alias("trg"), V.dot(F.col("vec"), F.array(*map(F.lit, near_weight))).alias("_b"))
    raw = edges.select("src", "trg").join(own, "src").join(near, "trg")
    e = F.col("_a") + F.col("_b")
    scored = raw.select("src", "trg", F.when(e > 0, e).otherwise(e * slope).alias("score"))
    return sparse.product_with_dense(sparse.softmax(scored, "src"), x)


def highway(gate: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """sigmoid(gate) * new + (1 - sigmoid(gate)) * old, by id."""
    g = gate.select("id", F.transform("vec", lambda x: V.sigmoid(x)).alias("_g"))
    rows = g.join(new.select("id", F.col("vec").alias("_n")), "id").join(old.select("id", F.col("vec").alias("_o")), "id")
    kept = F.transform("_g", lambda x: F.lit(1.0) - x)
    return rows.select("id", V.plus(V.times(F.col("_g"), F.col("_n")), V.times(kept, F.col("_o"))).alias("vec"))


def reflected_attention(edge_rel: DataFrame, entities: DataFrame, relations: DataFrame, kernel: list[float], depth: int = 1) -> DataFrame:
    """Relational reflection: (h, t, r, w), vectors (id, vec) of entities and relations, a kernel for [self, neighbour, relation].

    Each edge reflects its neighbour's vector at the hyperplane of the edge's mean relation vector; attention over an
    entity's edges weighs them. Returns the input layer and each further one, one after the other."""
    dim = len(kernel) // 3
    ks, kn, kr = (F.array(*map(F.lit, kernel[i * dim : (i + 1) * dim])) for i in range(3))
    rel = edge_rel.join(store(relations.select(F.col("id").alias("r"), "vec")), "r").select("h", "t", "w", F.posexplode("vec").alias("i", "x"))
    cells = rel.groupBy("h", "t", "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    axis = store(cells.groupBy("h", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).select("h", "t", V.unit(F.col("v"), 1e-12).alias("axis")))
    layer = entities.select("id", relu(F.col("vec")).alias("vec"))
    layers = [layer]
    for _ in range(depth):
        near = layer.select(F.col("id").alias("t"), F.col("vec").alias("n"))
        own = layer.select(F.col("id").alias("h"), F.col("vec").alias("s"))
        rows = axis.join(near, "t").join(own, "h")
        along = V.dot(F.col("n"), F.col("axis")) * 2
        rows = rows.withColumn("_along", along).withColumn("m", F.zip_with("n", "axis", lambda x, a: x - F.col("_along") * a))
        scored = rows.withColumn("score", V.dot(F.col("s"), ks) + V.dot(F.col("m"), kn) + V.dot(F.col("axis"), kr))
        w = W.partitionBy("h")
        weight = F.exp(F.col("score") - F.max("score").over(w))
        soft = scored.withColumn("_e", weight).withColumn("p", F.col("_e") / F.sum("_e").over(w)).select("h", "p", F.posexplode("m").alias("i", "x"))
        sums = soft.groupBy("h", "i").agg(F.sum(F.col("p") * F.col("x")).alias("x"))
        layer = sums.groupBy(F.col("h").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).select("id", relu(F.col("v")).alias("vec"))
        layer = store(layer)
        layers.append(layer)
    from kinmap.operators.tokens import concatenated

    return concatenated(layers)


def scaled_laplacian(adj: DataFrame, ids: DataFrame, rounds: int = 30, largest: float | None = None) -> DataFrame:
    """2 / L (I - normalized(A)) - I, its diagonal always stored. L is the Laplacian's largest eigenvalue: ``largest`` where that is
    known (2 if every edge joins two sides of the graph), else the outcome of so many rounds of power iteration."""
    one = sparse.from_pairs(ids.select(F.col("id").alias("src"), F.col("id").alias("trg")))
    lap = store(sparse.fuse([one, normalized(adj)], [1.0, -1.0]))
    value = largest or 1.0
    x = ids.select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0 + 0.5).alias("x"))
    for i in range(rounds if largest is None else 0):
        y = lap.join(x.withColumnRenamed("id", "trg"), "trg").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("score") * F.col("x")).alias("x"))
        value = math.sqrt(y.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 1.0)
        x = y.select("id", (F.col("x") / value).alias("x"))
        if i % 5 == 4:
            x = store(x)
    return store(sparse.fuse([lap, one], [2.0 / value, -1.0]))


def chebyshev(adj: DataFrame, ids: DataFrame, k: int, rounds: int = 30, largest: float | None = None) -> list[DataFrame]:
    """T_0 to T_k of the scaled Laplacian, as cells. T_k has a cell for each pair of entities within k steps."""
    scaled = scaled_laplacian(adj, ids, rounds, largest)
    out = [sparse.from_pairs(ids.select(F.col("id").alias("src"), F.col("id").alias("trg"))), scaled]
    for _ in range(2, k + 1):
        out.append(store(sparse.fuse([sparse.product(scaled, out[-1]), out[-2]], [2.0, -1.0])))
    return out[: k + 1]


def chebyshev_features(adj: DataFrame, ids: DataFrame, vectors: DataFrame, k: int, rounds: int = 30, largest: float | None = None) -> list[DataFrame]:
    """T_0 to T_k of the scaled Laplacian, each times the vectors (id, vec) of all ids. The recursion runs on the vectors, so no step has
    more cells than the graph has edges and entities."""
    scaled = scaled_laplacian(adj, ids, rounds, largest)
    out = [vectors, store(sparse.product_with_dense(scaled, vectors))]
    for _ in range(2, k + 1):
        y = sparse.product_with_dense(scaled, out[-1]).withColumnRenamed("vec", "_y")
        out.append(store(y.join(out[-2], "id").select("id", F.zip_with("_y", "vec", lambda a, b: 2 * a - b).alias("vec"))))
    return out[: k + 1]


# Partitions.


def entity_graph(triples: DataFrame, groups: DataFrame | None = None, known_weight: float = 1000.0, keep_between: bool = False) -> DataFrame:
    """Undirected edges (u < v, weight). The weight is 1: repeated triples don't add up. ``groups`` (id, part) glues each part's members:
    a star from its smallest, and all edges inside, get ``known_weight``; edges between two parts' members go unless kept."""
    edges = triples.filter("h <> t").select(F.least("h", "t").alias("u"), F.greatest("h", "t").alias("v")).distinct().withColumn("weight", F.lit(1.0))
    if groups is None:
        return edges
    star = groups.withColumn("u", F.min("id").over(W.partitionBy("part"))).filter("u <> id").select("u", F.col("id").alias("v"))
    every = edges.select("u", "v").union(star).distinct()
    marked = every.join(groups.select(F.col("id").alias("u"), F.col("part").alias("_p")), "u", "left").join(groups.select(F.col("id").alias("v"), F.col("part").alias("_q")), "v", "left")
    inside = F.coalesce(F.col("_p") == F.col("_q"), F.lit(False))
    between = F.coalesce(F.col("_p") != F.col("_q"), F.lit(False))
    if not keep_between:
        marked = marked.filter(~between)
    return marked.select("u", "v", F.when(inside, F.lit(known_weight)).otherwise(F.lit(1.0)).alias("weight"))


def random_parts(nodes: DataFrame, k: int, seed: int = 0, group: str | None = None) -> DataFrame:
    """(id[, group]) -> part: k parts of equal size, the rows of each group apart; no node is lost.

    Each part takes a range of a seeded hash; the bounds are quantiles, so that no window runs over all nodes."""
    h = nodes.withColumn("_h", F.xxhash64("id", F.lit(seed)))
    if group is None:
        cuts = h.approxQuantile("_h", [i / k for i in range(1, k)], 0.001) if k > 1 else []
        part = F.lit(0)
        for c in cuts:
            part = part + (F.col("_h") > F.lit(c)).cast("int")
        return h.withColumn("part", part).drop("_h")
    return h.withColumn("part", (F.ntile(k).over(W.partitionBy(group).orderBy("_h", "id")) - 1)).drop("_h")


def label_parts(edges: DataFrame, nodes: DataFrame, k: int, rounds: int = 5, slack: float = 1.1, seed: int = 0) -> DataFrame:
    """(u, v, weight), (id) -> (id, part): balanced parts by label propagation under a capacity.

    A node asks for the part with the largest edge weight to it. A part of more than slack * n / k
    wishes keeps those of the largest weight; others stay where they were. Rounds are stored."""
    both = store(edges.select(F.col("u").alias("id"), F.col("v").alias("near"), "weight").union(edges.select("v", "u", "weight")))

    def pull(parts: DataFrame) -> DataFrame:
        return both.join(parts.select(F.col("id").alias("near"), F.col("part").alias("p")), "near").groupBy("id", "p").agg(F.sum("weight").alias("w"))

    return _propagated(nodes, k, rounds, slack, seed, pull)


def _propagated(nodes: DataFrame, k: int, rounds: int, slack: float, seed: int, pull) -> DataFrame:
    """Rounds of label propagation; ``pull`` of (id, part) is (id, p, w), how much each part draws a node."""
    n = nodes.count()
    capacity = math.ceil(slack * n / k)
    parts = store(random_parts(nodes.select("id"), k, seed))
    for _ in range(rounds):
        wish = pull(parts).groupBy("id").agg(F.max_by("p", F.struct("w", -F.col("p"))).alias("wish"), F.max("w").alias("gain"))
        state = parts.join(wish, "id", "left").select("id", "part", F.coalesce("wish", "part").alias("wish"), F.coalesce("gain", F.lit(0.0)).alias("gain"))
        sizes = state.groupBy("part").agg(F.count("*").alias("size"))
        room = state.filter("wish <> part").join(sizes.select(F.col("part").alias("wish"), "size"), "wish", "left")
        place = F.row_number().over(W.partitionBy("wish").orderBy(F.desc("gain"), "id"))
        moved = room.withColumn("place", place).filter(F.col("place") <= F.lit(capacity) - F.coalesce("size", F.lit(0))).select("id", F.col("wish").alias("to"))
        parts = store(state.join(moved, "id", "left").select("id", F.coalesce("to", "part").alias("part")))
    return parts


def line_graph(triples: DataFrame) -> DataFrame:
    """(h, t) edges as nodes (hash ids e, f with e < f), joined where they share an entity; weight: the number of shared ones."""
    edges = triples.filter("h <> t").select(F.least("h", "t").alias("u"), F.greatest("h", "t").alias("v")).distinct().withColumn("e", F.xxhash64("u", "v"))
    at = edges.select("e", F.explode(F.array("u", "v")).alias("id"))
    return at.join(at.select(F.col("e").alias("f"), "id"), "id").filter("e < f").groupBy("e", "f").agg(F.count("*").alias("weight"))


def line_graph_size(triples: DataFrame) -> DataFrame:
    """One row: how many edges ``line_graph`` has, and their weights' sum. Two edges share one entity at most, so each entity of n edges adds
    n (n - 1) / 2 of weight 1; the pairs are not made."""
    edges = triples.filter("h <> t").select(F.least("h", "t").alias("u"), F.greatest("h", "t").alias("v")).distinct()
    n = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    pairs = F.sum(F.expr("n * (n - 1) div 2"))
    return n.agg(F.coalesce(pairs, F.lit(0)).alias("edges"), F.when(pairs > 0, pairs).alias("weight"))


def edge_parts(triples: DataFrame, k: int, rounds: int = 5, seed: int = 0) -> DataFrame:
    """Edges in k balanced parts: the line graph's nodes by label propagation. (u, v, part)."""
    edges = triples.filter("h <> t").select(F.least("h", "t").alias("u"), F.greatest("h", "t").alias("v")).distinct()
    at = store(edges.select(F.xxhash64("u", "v").alias("id"), F.explode(F.array("u", "v")).alias("x")))

    def pull(parts: DataFrame) -> DataFrame:
        # edges at either end that are in the part, without the edge itself: the line graph's weights, but not its pairs
        own = at.join(parts.withColumnRenamed("part", "p"), "id")
        held = own.groupBy("x", "p").agg(F.count("*").alias("n"))
        near = at.join(held, "x").groupBy("id", "p").agg(F.sum("n").alias("n")).join(parts, "id")
        return near.select("id", "p", (F.col("n") - F.when(F.col("p") == F.col("part"), 2).otherwise(0)).cast("double").alias("w")).filter("w > 0")

    parts = _propagated(edges.select(F.xxhash64("u", "v").alias("id")), k, rounds, 1.1, seed, pull)
    return edges.join(parts, F.xxhash64("u", "v") == F.col("id")).select("u", "v", "part")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(part, id) tables -> (src, trg, score): shared members over the source part's size + 0.01."""
    size = a.groupBy(F.col("part").alias("src")).agg(F.count("*").alias("n"))
    both = a.select(F.col("part").alias("src"), "id").join(b.select(F.col("part").alias("trg"), "id"), "id").groupBy("src", "trg").agg(F.count("*").alias("c"))
    return both.join(size, "src").select("src", "trg", (F.col("c") / (F.col("n") + 0.01)).alias("score"))


def placed(triples: DataFrame, parts: DataFrame) -> DataFrame:
    """Triples whose ends are in the same part, with it."""
    a = parts.select(F.col("id").alias("h"), "part")
    b = parts.select(F.col("id").alias("t"), F.col("part").alias("_q"))
    return triples.join(a, "h").join(b, "t").filter("part = _q").select("part", "h", "r", "t")


def batches(src_parts: DataFrame, trg_parts: DataFrame, links: DataFrame, top: int = 1) -> DataFrame:
    """(batch, side, id): each source part with the ``top`` target parts that hold most of its linked entities' counterparts."""
    from kinmap.operators.knn import top_k

    seeds = links.join(src_parts.select(F.col("id").alias("src"), "part"), "src").select("part", F.col("trg").alias("id"))
    best = top_k(overlaps(seeds, trg_parts), top)
    mine = src_parts.select(F.col("part").alias("batch"), F.lit(1).alias("side"), "id")
    theirs = best.select(F.col("src").alias("batch"), F.col("trg").alias("part")).join(trg_parts, "part").select("batch", F.lit(2).alias("side"), "id")
    return mine.unionByName(theirs)


def batch_triples(triples1: DataFrame, triples2: DataFrame, members: DataFrame) -> DataFrame:
    """Triples with both ends in a batch: (batch, side, h, r, t)."""
    out = []
    for side, triples in ((1, triples1), (2, triples2)):
        own = members.filter(F.col("side") == side).select("batch", "id")
        a, b = own.withColumnRenamed("id", "h"), own.select(F.col("batch").alias("_b"), F.col("id").alias("t"))
        out.append(triples.join(a, "h").join(b, "t").filter("batch = _b").select("batch", F.lit(side).alias("side"), "h", "r", "t"))
    return out[0].unionByName(out[1])


def part_report(triples: DataFrame, parts: DataFrame) -> DataFrame:
    """Share of triples kept, and the parts' sizes: least, largest, mean, population deviation."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    kept = placed(triples, parts).agg(F.count("*").alias("kept"))
    all_ = triples.agg(F.count("*").alias("triples"))
    stats = sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))
    return kept.crossJoin(all_).crossJoin(stats)  # one row each
