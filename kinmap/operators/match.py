"""Pairs from similarity tables: mutual best, margins, bootstrapping, one-to-one matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinmap.operators import sparse
from kinmap.operators.knn import csls, nearest, top_k
from kinmap.operators.storage import store


def mutual_best(sim: DataFrame) -> DataFrame:
    """Pairs that are each other's best; ties to the smallest index."""
    a = sparse.argmax(sim, "src")
    b = sparse.argmax(sim, "trg").select("src", "trg")
    return a.join(b, ["src", "trg"]).select("src", "trg", "score")


def mutual_with_margin(sim: DataFrame, margin: float) -> DataFrame:
    """Mutual best pairs that beat the runner-up by ``margin`` at least from both sides. A side without a runner-up passes."""

    def best(by: str, o: str) -> DataFrame:
        two = top_k(sim, 2, by, "_r").groupBy(by).agg(
            F.max(F.when(F.col("_r") == 1, F.col(o))).alias(o), F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("_second")
        )
        return two.filter(F.col("_second").isNull() | (F.col("score") - F.col("_second") >= margin)).select(by, o, "score")

    return best("src", "trg").join(best("trg", "src").select("src", "trg"), ["src", "trg"]).select("src", "trg", "score")


def pseudo_links(tables: list[DataFrame | None], weights: list[float]) -> DataFrame:
    """Seeds for training: the fused table's mutual best pairs."""
    return mutual_best(sparse.fuse(tables, weights)).select("src", "trg")


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old pairs and those new ones neither end of which is used."""
    free = new.join(old.select("src"), "src", "left_anti").join(old.select("trg"), "trg", "left_anti")
    return old.select("src", "trg").unionByName(free.select("src", "trg"))


def more_pairs(vectors1: DataFrame, vectors2: DataFrame, train: DataFrame, k: int = 50, hub: int = 10) -> DataFrame:
    """One round of pseudo-labelling: training pairs, and mutual best pairs (after hub correction) of the entities in none."""
    a = vectors1.join(train.select(F.col("src").alias("id")), "id", "left_anti")
    b = vectors2.join(train.select(F.col("trg").alias("id")), "id", "left_anti")
    sim = store(nearest(a, b, k, "cosine"))
    return appended(train, mutual_best(csls(sim, hub)))


def above(sim: DataFrame, threshold: float, greater: bool = True, equal: bool = False) -> DataFrame:
    """Cells above the threshold, or below it; ``equal``: or at it."""
    return sim.filter(is_above(threshold, greater, equal))


def is_above(threshold: float, greater: bool = True, equal: bool = False) -> Column:
    s = F.col("score")
    return (s >= threshold if equal else s > threshold) if greater else (s <= threshold if equal else s < threshold)


def potential(sim: DataFrame, threshold: float, k: int) -> DataFrame:
    """Cells above the threshold that are among their source's k best."""
    return top_k(sim, k).filter(F.col("score") > threshold)


def still_close(pairs: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Pairs whose similarity has not fallen."""
    a = before.select("src", "trg", F.col("score").alias("_x"))
    b = now.select("src", "trg", F.col("score").alias("_y"))
    return pairs.join(a, ["src", "trg"]).join(b, ["src", "trg"]).filter("_x <= _y").select("src", "trg")


def greedy_matching(sim: DataFrame, most_rounds: int = 100) -> DataFrame:
    """One-to-one pairs of large total weight: mutual best pairs are taken and their ends leave, until none is left.

    The total is at least half the best one's. Each round takes every pair that no neighbour beats, so few are needed.
    """
    left, taken = store(sim.select("src", "trg", "score")), None
    for _ in range(most_rounds):
        found = store(mutual_best(left))
        if found.isEmpty():
            break
        taken = found if taken is None else taken.unionByName(found)
        left = store(left.join(found.select("src"), "src", "left_anti").join(found.select("trg"), "trg", "left_anti"))
    return taken if taken is not None else sim.select("src", "trg", "score").limit(0)


def matching(sim: DataFrame, threshold: float, k: int, method=greedy_matching) -> DataFrame:
    """Potential pairs, then a one-to-one choice by ``method``."""
    return method(potential(sim, threshold, k))


def relabelled(labelled: DataFrame, new: DataFrame, sim: DataFrame) -> DataFrame:
    """A source takes its new target if that is as similar as the old one at least (unknown cells count as 0); then a target keeps its most similar source."""
    s = lambda n: sim.select("src", F.col("trg").alias(n), F.col("score").alias(f"_{n}"))
    both = labelled.select("src", F.col("trg").alias("old")).join(new.select("src", F.col("trg").alias("new")), "src", "full")
    scored = both.join(s("old"), ["src", "old"], "left").join(s("new"), ["src", "new"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    take = F.col("old").isNull() | (F.col("new").isNotNull() & (zero("_new") >= zero("_old")))
    chosen = scored.select("src", F.when(take, F.col("new")).otherwise(F.col("old")).alias("trg"), F.when(take, zero("_new")).otherwise(zero("_old")).alias("score"))
    return chosen.groupBy("trg").agg(F.max_by("src", F.struct("score", -F.col("src"))).alias("src")).select("src", "trg")


def bootstrapped(labelled: DataFrame, sim: DataFrame, threshold: float, k: int, edit: bool = True) -> DataFrame:
    """One step of bootstrapping: potential pairs matched one to one, merged into the labels if ``edit``."""
    new = matching(sim, threshold, k).select("src", "trg")
    return relabelled(labelled, new, sim) if edit else new


def paired_greedily(sim: DataFrame, threshold: float, k: int) -> DataFrame:
    """Each source's best cell that is in both ends' k best and above the threshold."""
    rows = top_k(sim, k, "src").filter(F.col("score") > threshold)
    cols = top_k(sim, k, "trg").select("src", "trg")
    return top_k(rows.join(cols, ["src", "trg"]).select("src", "trg", "score"), 1)


def widened_triple_negatives(triples: DataFrame, nodes: DataFrame, k: int, seed: int = 0, tries: int = 10) -> DataFrame:
    """k typed negatives of each triple. One that is a true triple is drawn again, ``tries`` times from the relation's own ends, and then
    once a round from all nodes until none is left (a node that is linked to all others by every relation would never end: it fails after as many rounds)."""
    triples, nodes = store(triples.select("h", "r", "t")), store(nodes.select("id"))
    left = store(triples.select("h", "r", "t", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")))
    out = None
    for attempt in range(2 * tries):
        made = store(_negatives(left, triples, nodes, seed + attempt, attempt < tries))
        out = made if out is None else out.unionByName(made)
        left = store(left.join(made.select("h", "r", "t", "i"), ["h", "r", "t", "i"], "left_anti"))
        if left.isEmpty():
            return out
    raise RuntimeError("some triples have no wrong ends")


def random_triple_negatives(triples: DataFrame, nodes: DataFrame, k: int, seed: int = 0, typed: bool = False) -> DataFrame:
    """k corrupted copies of each triple (h, r, t, h2, r, t2, i): head or tail is replaced by another node, or, typed, by one seen in that place
    of the relation. Copies that are true triples go (``widened_triple_negatives`` draws them again). Choices are seeded hashes; nodes are
    picked by dense number, not collected."""
    copies = triples.select("h", "r", "t", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    return _negatives(copies, triples, nodes, seed, typed)


def _negatives(copies: DataFrame, triples: DataFrame, nodes: DataFrame, seed: int, typed: bool) -> DataFrame:
    from kinmap.sources.graphs import numbered

    pick = F.xxhash64("h", "r", "t", "i", F.lit(seed))
    copies = copies.withColumn("_head", pick > 0)
    if typed:
        ends = triples.select("r", F.lit(True).alias("_head"), F.col("h").alias("x")).union(triples.select("r", F.lit(False), "t")).distinct()
        w = W.partitionBy("r", "_head")
        pool = ends.withColumn("_n", F.row_number().over(w.orderBy("x")) - 1)
        size = ends.groupBy("r", "_head").agg(F.count("*").alias("_size"))
        chosen = copies.join(size, ["r", "_head"]).withColumn("_n", F.pmod(F.xxhash64(pick), F.col("_size")).cast("int")).join(pool, ["r", "_head", "_n"])
    else:
        n = nodes.count()
        pool = numbered(nodes.select(F.col("id").alias("x")), ["x"], "_n")
        chosen = copies.withColumn("_n", F.pmod(F.xxhash64(pick), F.lit(n))).join(pool, "_n")
    bad = chosen.select("h", "r", "t", "i", F.when(F.col("_head"), F.col("x")).otherwise(F.col("h")).alias("h2"), F.when(F.col("_head"), F.col("t")).otherwise(F.col("x")).alias("t2"))
    true = triples.select(F.col("h").alias("h2"), "r", F.col("t").alias("t2")).distinct()
    return bad.join(true, ["h2", "r", "t2"], "left_anti").select("h", "r", "t", "h2", "t2", "i")


def random_pair_negatives(pairs: DataFrame, nodes1: DataFrame, nodes2: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """For each pair k wrong targets and k wrong sources: (src, trg, src2, trg2)."""
    from kinmap.sources.graphs import numbered

    out = []
    for side, nodes in ((1, nodes1), (2, nodes2)):
        n = nodes.count()
        pool = numbered(nodes.select(F.col("id").alias("x")), ["x"], "_n")
        copies = pairs.select("src", "trg", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
        rows = copies.withColumn("_n", F.pmod(F.xxhash64("src", "trg", "i", F.lit(seed + side)), F.lit(n))).join(pool, "_n")
        kept = rows.filter(F.col("x") != F.col("src" if side == 1 else "trg"))
        out.append(kept.select("src", "trg", (F.col("x") if side == 1 else F.col("src")).alias("src2"), (F.col("trg") if side == 1 else F.col("x")).alias("trg2")))
    return out[0].unionByName(out[1])
