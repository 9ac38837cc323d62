"""Nearest neighbours, top-k, and hub correction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinmap.functions import vectors as V


def top_k(sim: DataFrame, k: int, by: str = "src", rank: str | None = None) -> DataFrame:
    """The k best cells of each row or column, ties to the smallest index. Spark limits each map task's groups to k rows
    before the shuffle."""
    o = "trg" if by == "src" else "src"
    r = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), o))
    out = sim.withColumn("_r", r).filter(F.col("_r") <= k)
    return out.withColumnRenamed("_r", rank) if rank else out.drop("_r")


def ranked(sim: DataFrame, by: str = "src") -> DataFrame:
    o = "trg" if by == "src" else "src"
    return sim.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), o)).cast("long"))


def packed(side: DataFrame, rows: int, group: str | None = None, most: int | None = None, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(id, vec) -> blocks of about ``rows`` vectors each, (_g, block, ids, vecs), and the number of blocks of each group, (_g, n).

    A group is cut by its own size; without groups all is one group. ``most``: blocks grow up to so many vectors once there are 48 of
    them, so that fewer copies cross the network. ``more``: columns that go with the vectors, as lists under their names."""
    marked = side.withColumn("_g", F.col(group) if group else F.lit(0))
    n = F.ceil(F.count("*") / F.lit(rows))
    n = n if most is None else F.greatest(F.least(n, F.lit(48)), F.ceil(F.count("*") / F.lit(most)))
    sizes = marked.groupBy("_g").agg(n.cast("int").alias("n"))
    cut = marked.join(sizes if group else F.broadcast(sizes), "_g")  # without groups sizes are one row
    blocks = cut.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).groupBy("_g", "block")
    return blocks.agg(F.collect_list("id").alias("ids"), F.collect_list(V.doubles(F.col("vec"))).alias("vecs"), *[F.collect_list(c).alias(c) for c in more]), sizes


def block_pairs(src: DataFrame, trg: DataFrame, rows: int, group: str | None = None, most: int | None = None, more: tuple[str, ...] = (), others: tuple[str, ...] = ()) -> DataFrame:
    """(s, sv, t, tv): ids and vectors of each block of either side that share a group, ``more`` columns of the first and ``others`` of the second side.
    Neither side is broadcast; a block crosses the network once for each block of the other side in its group, which is the price of an exact search."""
    a, _ = packed(src, rows, group, most, more)
    b, n = packed(trg, rows, group, most, others)
    a = a.join(n if group else F.broadcast(n), "_g")
    a = a.select("_g", F.col("ids").alias("s"), F.col("vecs").alias("sv"), *more, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("tb"))
    return a.join(b.select("_g", F.col("block").alias("tb"), F.col("ids").alias("t"), F.col("vecs").alias("tv"), *others), ["_g", "tb"]).select("s", "sv", "t", "tv", *more, *others)


def dense(src: DataFrame, trg: DataFrame, metric: str = "sqeuclidean", rows: int = 512) -> DataFrame:
    """Every cell of two vector tables: (src, trg, score). For operators whose result is the whole matrix; ``nearest`` gives the best ones.
    Each pair of blocks is scored row by row in a task of its own, so equal vectors have equal scores."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for s, sv, t, tv in zip(frame.s, frame.sv, frame.t, frame.tv, strict=True):
                x, y, t = np.stack([np.asarray(v, float) for v in sv]), np.stack([np.asarray(v, float) for v in tv]), np.asarray(t)
                step = max(1, (1 << 18) // len(t))
                for at in range(0, len(x), step):
                    m = np.stack([row_scores(v, y, metric) for v in x[at : at + step]])
                    yield pd.DataFrame({"src": np.repeat(np.asarray(s)[at : at + step], len(t)), "trg": np.tile(t, len(m)), "score": m.ravel()})

    own = lambda df: df.select("id", "vec")
    return block_pairs(own(src), own(trg), rows, most=8192).mapInPandas(score, "src long, trg long, score double")


def cells_at(pairs: DataFrame, src: DataFrame, trg: DataFrame, metric: str = "sqeuclidean") -> DataFrame:
    """The cells of these pairs alone: (src, trg, score)."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                yield pd.DataFrame({"src": f.src, "trg": f.trg, "score": paired_scores(np.stack(f.x.to_list()), np.stack(f.y.to_list()), metric)})

    ends = pairs.join(src.select(F.col("id").alias("src"), V.doubles(F.col("vec")).alias("x")), "src").join(trg.select(F.col("id").alias("trg"), V.doubles(F.col("vec")).alias("y")), "trg")
    return ends.select("src", "trg", "x", "y").mapInPandas(score, "src long, trg long, score double")


def row_scores(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """One vector against many."""
    if metric in ("inner", "cosine"):
        dot = np.einsum("ij,j->i", y, x)
        return dot if metric == "inner" else dot / np.maximum(np.linalg.norm(x) * np.linalg.norm(y, axis=1), 1e-8)
    d = y - x
    if metric == "manhattan":
        return 1 - np.abs(d).sum(axis=1)
    square = np.einsum("ij,ij->i", d, d)
    if metric in ("sqeuclidean", "euclidean"):
        return 1 - (square if metric == "sqeuclidean" else np.sqrt(square))
    raise ValueError(f"unknown metric {metric}")


def nearest(src: DataFrame, trg: DataFrame, k: int = 50, metric: str = "sqeuclidean", rows: int = 2048, exclude_self: bool = False, normalize: bool = False, group: str | None = None, exact: bool = False) -> DataFrame:
    """Exact k nearest targets of each source: (src, trg, score), scores as in ``vectors.similarity``.

    Both sides are packed into blocks of bounded size. Each pair of blocks is one matrix product in a task of its
    own that gives at most k cells for each source; the final top-k then merges a source's blocks. Neither
    side is broadcast. ``group``: only pairs that agree in this column; each group has blocks by its own size. ``exact``: the scores
    are those of ``dense``, not a matrix product's, whose last digits may differ between equal vectors."""
    prepared = lambda df: df.select("id", (V.unit(V.doubles(F.col("vec"))) if normalize else V.doubles(F.col("vec"))).alias("vec"), *([group] if group else []))
    pairs = block_pairs(prepared(src), prepared(trg), rows, group)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for s, sv, t, tv in zip(frame.s, frame.sv, frame.t, frame.tv, strict=True):
                s, t = np.asarray(s), np.asarray(t)
                x, y = np.stack([np.asarray(v, float) for v in sv]), np.stack([np.asarray(v, float) for v in tv])
                for at in range(0, len(s), 512):
                    m = scores(x[at : at + 512], y, metric)
                    if exclude_self:
                        m[s[at : at + 512, None] == t[None, :]] = -np.inf
                    kk = min(k, len(t))
                    # ties at the k-th place: all of them go on, so that the smallest ids win below
                    edge = -np.partition(-m, kk - 1, axis=1)[:, kk - 1]
                    if exact:
                        edge = edge - 2 * slack(x[at : at + 512], y)
                    i, j = np.nonzero((m >= edge[:, None]) & (m > -np.inf))
                    yield pd.DataFrame({"src": s[at + i], "trg": t[j], "score": paired_scores(x[at + i], y[j], metric) if exact else m[i, j]})

    found = pairs.mapInPandas(score, "src long, trg long, score double")
    return top_k(found, k)


def paired_scores(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Row against row."""
    if metric in ("inner", "cosine"):
        dot = np.einsum("ij,ij->i", y, x)
        return dot if metric == "inner" else dot / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-8)
    d = y - x
    if metric == "manhattan":
        return 1 - np.abs(d).sum(axis=1)
    square = np.einsum("ij,ij->i", d, d)
    return 1 - (square if metric == "sqeuclidean" else np.sqrt(square))


def slack(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far ``scores`` of each row of x may be from ``paired_scores``, with plenty to spare; not for "euclidean" near 0."""
    return 1e-11 * (1 + (x * x).sum(axis=1) + (y * y).sum(axis=1).max(initial=0))


def scores(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "inner":
        return x @ y.T
    if metric == "cosine":
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)) @ (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-8)).T
    if metric == "manhattan":
        return 1 - np.stack([np.abs(row - y).sum(axis=1) for row in x])
    square = np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)
    if metric == "sqeuclidean":
        return 1 - square
    if metric == "euclidean":
        return 1 - np.sqrt(square)
    raise ValueError(f"unknown metric {metric}")


def neighbours(vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """id -> its k nearest others, nearest first."""
    near = nearest(vectors, vectors, k, metric, exclude_self=True)
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "trg")))
    return near.groupBy(F.col("src").alias("id")).agg(F.transform(order, lambda x: x["trg"]).alias("near"))


def csls(sim: DataFrame, k: int = 10) -> DataFrame:
    """2 s - (mean of the source's k best) - (mean of the target's k best): hubs lose."""
    rows = top_k(sim, k, "src").groupBy("src").agg(F.avg("score").alias("_r"))
    cols = top_k(sim, k, "trg").groupBy("trg").agg(F.avg("score").alias("_c"))
    return sim.join(rows, "src").join(cols, "trg").select("src", "trg", (F.col("score") * 2 - F.col("_r") - F.col("_c")).alias("score"))


def rank_sum(sim: DataFrame) -> DataFrame:
    """Rank from either side, added: lower is better."""
    a = F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "trg"))
    b = F.row_number().over(W.partitionBy("trg").orderBy(F.desc("score"), "src"))
    return sim.select("src", "trg", (a + b).cast("long").alias("rank"))


def rank_max(a: DataFrame, b: DataFrame) -> DataFrame:
    """The larger of the ranks that two tables give a pair."""
    y = ranked(b).select("src", "trg", F.col("rank").alias("_r"))
    return ranked(a).join(y, ["src", "trg"]).select("src", "trg", F.greatest("rank", "_r").alias("rank"))


def nearest_negatives(vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest others of each vector, as negative samples: (id, negative)."""
    return nearest(vectors, vectors, k, metric, exclude_self=True).select(F.col("src").alias("id"), F.col("trg").alias("negative"))


def bonus_rank(sim: DataFrame, chosen: DataFrame, bonus: float = 1.0) -> DataFrame:
    """Ranks after pairs that are chosen already have had ``bonus`` added."""
    marked = sim.join(chosen.select("src", "trg", F.lit(bonus).alias("_b")), ["src", "trg"], "left")
    return ranked(marked.select("src", "trg", (F.col("score") + F.coalesce("_b", F.lit(0.0))).alias("score")))
