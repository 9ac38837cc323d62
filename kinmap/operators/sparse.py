"""Sparse matrices as (src, trg, score) rows: filters, products, reductions, normalisation, set operations."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Comparisons of the filter mini-language; ``eq`` and ``ne`` take lists as well.
COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c.isin(*v) if isinstance(v, (list, tuple, set)) else c == v,
    "ne": lambda c, v: ~c.isin(*v) if isinstance(v, (list, tuple, set)) else c != v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
}


def where(sim: DataFrame, **conditions) -> DataFrame:
    """Cells for which all conditions hold: column=(op, value), or column=[(op, value), ...]. Pushed down to the scan."""
    for column, rules in conditions.items():
        for op, value in rules if isinstance(rules, list) else [rules]:
            sim = sim.filter(COMPARE[op](F.col(column), value))
    return sim


def shift(sim: DataFrame, src: int = 0, trg: int = 0) -> DataFrame:
    return sim.withColumn("src", F.col("src") + src).withColumn("trg", F.col("trg") + trg)


def from_pairs(pairs: DataFrame, value: float = 1.0) -> DataFrame:
    return pairs.select("src", "trg", F.lit(value).alias("score"))


def apply(sim: DataFrame, function: Callable[[Column], Column]) -> DataFrame:
    """A column function over the stored values."""
    return sim.withColumn("score", function(F.col("score")))


def coalesced(sim: DataFrame) -> DataFrame:
    """One row for each cell: repeated cells add up."""
    return sim.groupBy("src", "trg").agg(F.sum("score").alias("score"))


def binary(sim: DataFrame) -> DataFrame:
    return from_pairs(sim.select("src", "trg").distinct())


def elementwise(sim: DataFrame, dense: DataFrame, op: Callable[[Column, Column], Column]) -> DataFrame:
    """``op`` of a sparse cell and the dense cell at its place."""
    other = dense.select("src", "trg", F.col("score").alias("_d"))
    return sim.join(other, ["src", "trg"]).select("src", "trg", op(F.col("score"), F.col("_d")).alias("score"))


def elementwise_outer(sim: DataFrame, rows: DataFrame, columns: DataFrame, value: Callable[[Column, Column], Column], op: Callable[[Column, Column], Column]) -> DataFrame:
    """``elementwise`` for a dense table whose cell is ``value`` of its row's and its column's x, (id, x) each: only the cells that ``sim`` has are made."""
    ends = sim.join(rows.select(F.col("id").alias("src"), F.col("x").alias("_x")), "src").join(columns.select(F.col("id").alias("trg"), F.col("x").alias("_y")), "trg")
    return ends.select("src", "trg", op(F.col("score"), value(F.col("_x"), F.col("_y"))).alias("score"))


def to_sparse(rows: DataFrame) -> DataFrame:
    """(src, vec) rows of a dense matrix -> its cells that are not 0."""
    return rows.select("src", F.posexplode("vec").alias("trg", "score")).filter("score <> 0").select("src", F.col("trg").cast("long").alias("trg"), "score")


def to_dense(sim: DataFrame, width: int) -> DataFrame:
    """Cells -> (src, vec), 0 where no cell is. Rows without cells are left out."""
    at = coalesced(sim).groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct(F.col("trg").cast("int"), "score"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return at.select("src", vec.alias("vec"))


#: Products that a block of rows makes, about.
BLOCK = 1 << 24


def product(a: DataFrame, b: DataFrame, salt: int = 0) -> DataFrame:
    """Sparse product: sum over the shared index. Rows of ``a`` are made in blocks of neighbouring rows, whole in one task, so single products are
    neither joined nor shuffled: a row of ``b`` goes once to each block that needs it. Hubs of the shared index thus go to many blocks, none of
    which is skewed; ``salt`` makes so many times more blocks."""
    return _row_product(a, b, salt, None)


def _row_product(a: DataFrame, b: DataFrame, salt: int, least: float | None) -> DataFrame:
    """``product``; with ``least`` its rows' softmax, cells of at least that."""
    left = a.select("src", F.col("trg").alias("_j"), F.col("score").alias("_a"))
    right = b.select(F.col("src").alias("_j"), "trg", F.col("score").alias("_b"))
    kinds = {c: t.dataType.simpleString() for c, t in (("src", a.schema["src"]), ("trg", b.schema["trg"]))}
    if set(kinds.values()) - {"int", "bigint"} or {a.schema["trg"].dataType.simpleString(), b.schema["src"].dataType.simpleString()} - {"int", "bigint"}:
        made = left.join(right, "_j").groupBy("src", "trg").agg(F.sum(F.col("_a") * F.col("_b")).alias("score"))
        return made if least is None else softmax(made, "src").filter(F.col("score") >= least)
    from kinmap.operators.storage import store

    rows = store(right.filter("_j is not null and trg is not null and _b is not null").groupBy("_j").agg(F.collect_list("trg").alias("t"), F.collect_list("_b").alias("b"), F.count("*").alias("_n")))
    work = left.join(rows.select("_j", "_n"), "_j").select("src", "_j", F.col("_a").cast("double").alias("_a"), "_n").filter("src is not null and _a is not null")
    work = store(work)
    total = work.agg(F.sum("_n")).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK)) * max(1, salt)
    # ranges of neighbouring rows, by a sample's quantiles that weigh each row by its cells
    cuts = sorted(set(work.approxQuantile("src", [i / n for i in range(1, n)], min(0.01, 0.2 / n)))) if n > 1 else []
    block = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(float(c)) for c in cuts])
        block = F.size(F.filter(edges, lambda c: c < F.col("src"))) if len(cuts) <= 64 else None
    if block is None:
        search = F.pandas_udf(lambda x: pd.Series(np.searchsorted(np.asarray(cuts), x.to_numpy()).astype("int32")), "int")
        block = search(F.col("src").cast("double"))
    work = work.withColumn("_g", block.cast("int"))
    mine = work.groupBy("_g", "_j").agg(F.collect_list("src").alias("s"), F.collect_list("_a").alias("a"))
    met = mine.join(rows, "_j").select("_g", "s", "a", "t", "b")

    def multiplied(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """One block's outer products, a range of its rows at a time."""
        flat = lambda c, k: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(k)
        width = lambda c: np.asarray(pc.list_value_length(t.column(c).combine_chunks()))
        s, x, at = flat("s", np.int64), flat("a", float), np.repeat(np.arange(len(t)), width("s"))
        trg, y, size = flat("t", np.int64), flat("b", float), width("b")
        names, code = np.unique(trg, return_inverse=True)
        begin = np.cumsum(size) - size
        order = np.argsort(s, kind="stable")
        s, x, at = s[order], x[order], at[order]
        used, starts = np.unique(s, return_index=True)
        done = np.append(np.cumsum(size[at]), 0)
        lo = 0
        while lo < len(used):
            # as many rows as make about a million products and a million places for sums, one at least
            base = done[starts[lo] - 1] if starts[lo] else 0
            ends = done[np.append(starts[1:], len(s)) - 1]
            hi = max(lo + 1, min(int(np.searchsorted(ends, base + (1 << 20), "right")), lo + max(1, (1 << 20) // len(names))))
            p, q = starts[lo], starts[hi] if hi < len(used) else len(s)
            count = size[at[p:q]]
            pick = np.repeat(begin[at[p:q]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            row = np.repeat(np.searchsorted(used[lo:hi], s[p:q]), count)
            key = row * len(names) + code[pick]
            score = np.bincount(key, np.repeat(x[p:q], count) * y[pick], (hi - lo) * len(names))
            there = np.flatnonzero(np.bincount(key, minlength=len(score)))
            row, column, score = there // len(names), there % len(names), score[there]
            if least is not None and len(score):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                of = np.cumsum(np.diff(row, prepend=-1) > 0) - 1
                e = np.exp(score - np.maximum.reduceat(score, first)[of])
                score = e / np.add.reduceat(e, first)[of]
                keep = score >= least
                row, column, score = row[keep], column[keep], score[keep]
            for z in range(0, len(score), 1 << 18):
                w = slice(z, z + (1 << 18))
                yield used[lo:hi][row[w]], names[column[w]], score[w]
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        out = lambda c: pa.RecordBatch.from_arrays([pa.array(c[0]).cast(kind[0]), pa.array(c[1]).cast(kind[1]), pa.array(c[2])], ["src", "trg", "score"])
        for batch in batches:
            g = batch.column("_g").to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g)) + 1) if len(g) else []:
                if group is not None and g[part[0]] != group:
                    yield from map(out, multiplied(pa.Table.from_batches(held)))
                    held = []
                group = g[part[0]]
                held.append(batch.slice(int(part[0]), len(part)))
        if held:
            yield from map(out, multiplied(pa.Table.from_batches(held)))

    kind = [pa.int64() if kinds[c] == "bigint" else pa.int32() for c in ("src", "trg")]
    return met.repartition(n, "_g").sortWithinPartitions("_g").mapInArrow(run, f"src {kinds['src']}, trg {kinds['trg']}, score double")


def product_with_dense(sim: DataFrame, vectors: DataFrame, width: int | None = None) -> DataFrame:
    """Sparse (src, trg, score) times dense (id, vec) -> (id, vec): weighted sums of the rows' vectors, which have ``width`` numbers (it is looked up
    where it is not given). A row takes part as one row of so many sums; only wide vectors, or those of unequal length, are taken apart."""
    if width is None:
        least, width = vectors.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
        width = width if least == width else None
    cells = sim.join(vectors.withColumnRenamed("id", "trg"), "trg")
    if width and width <= 90:
        sums = cells.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("score") * F.col("vec")[i]).alias(f"_{i}") for i in range(width)])
        return sums.select("id", F.array(*[f"_{i}" for i in range(width)]).alias("vec"))
    cells = cells.select("src", "score", F.posexplode("vec").alias("i", "x"))
    sums = cells.groupBy("src", "i").agg(F.sum(F.col("score") * F.col("x")).alias("x"))
    return sums.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))


def pruned_product(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Product, softmax of its rows, cells of at least ``least``."""
    return _row_product(a, b, 0, least)


def reduce_by(sim: DataFrame, by: str, op: str) -> DataFrame:
    """sum, mean, min, max or mul of the stored values of each row (by="src") or column."""
    value = F.col("score")
    ops = {"sum": F.sum(value), "mean": F.avg(value), "min": F.min(value), "max": F.max(value), "mul": F.product(value)}
    return sim.groupBy(by).agg(ops[op].alias("score"))


def other(by: str) -> str:
    return "trg" if by == "src" else "src"


def argmax(sim: DataFrame, by: str = "src") -> DataFrame:
    """The best cell of each row or column; ties go to the smallest index. Rows without cells have none."""
    o = other(by)
    return sim.groupBy(by).agg(F.max_by(o, F.struct(F.col("score"), -F.col(o))).alias(o), F.max("score").alias("score"))


def argmin(sim: DataFrame, by: str = "src") -> DataFrame:
    o = other(by)
    return sim.groupBy(by).agg(F.min_by(o, F.struct(F.col("score"), F.col(o))).alias(o), F.min("score").alias("score"))


def argmax_of(values: list[Column]) -> Column:
    """Which of these columns is largest, from 0; the first of equals. Nulls never are."""
    return F.array_position(F.array(*values), F.greatest(*values)) - 1


def argmin_of(values: list[Column]) -> Column:
    return F.array_position(F.array(*values), F.least(*values)) - 1


def softmax(sim: DataFrame, by: str = "src") -> DataFrame:
    w = W.partitionBy(by)
    e = F.exp(F.col("score") - F.max("score").over(w))
    return sim.withColumn("_e", e).withColumn("score", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def minmax(sim: DataFrame, by: str | None = None, eps: float = 1e-8, masked: bool = False) -> DataFrame:
    """(x - min) / (max - min + eps): of each row or column, or of all stored values. masked: zeros stay and don't count."""
    used = F.when(F.col("score") != 0, F.col("score")) if masked else F.col("score")
    if by:
        w = W.partitionBy(by)
        low, high = F.min(used).over(w), F.max(used).over(w)
        scaled = (F.col("score") - low) / (high - low + eps)
    else:
        bounds = sim.agg(F.min(used).alias("_lo"), F.max(used).alias("_hi"))
        sim = sim.crossJoin(F.broadcast(bounds))  # one row
        scaled = (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps)
    value = F.when(F.col("score") == 0, F.lit(0.0)).otherwise(scaled) if masked else scaled
    return sim.withColumn("score", value).drop("_lo", "_hi")


def fuse(tables: list[DataFrame | None], weights: list[float] | None = None) -> DataFrame:
    """Weighted sum of similarity tables; those that are None are skipped."""
    weights = weights or [1.0] * len(tables)
    live = [t.select("src", "trg", (F.col("score") * F.lit(float(w))).alias("score")) for t, w in zip(tables, weights, strict=True) if t is not None]
    return coalesced(functools.reduce(DataFrame.unionByName, live))


def stacked(tables: list[DataFrame], sizes: list[int]) -> DataFrame:
    """Tables one below the other: each one's rows are numbered after those before."""
    base, out = 0, []
    for t, n in zip(tables, sizes, strict=True):
        out.append(shift(t, base))
        base += n
    return functools.reduce(DataFrame.unionByName, out)


def minus(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on), on, "left_anti")


def cross(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on), on, "left_semi")


def between(sim: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells whose ends are both candidates."""
    return cross(cross(sim, sources.select(F.col("id").alias("src")), ["src"]), targets.select(F.col("id").alias("trg")), ["trg"])


def renamed(sim: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells under new numbers: both tables have (old, new)."""
    a = sources.select(F.col("old").alias("src"), F.col("new").alias("_s"))
    b = targets.select(F.col("old").alias("trg"), F.col("new").alias("_t"))
    return sim.join(a, "src").join(b, "trg").select(F.col("_s").alias("src"), F.col("_t").alias("trg"), "score")


def renumbered(nodes: DataFrame, group: str = "batch") -> DataFrame:
    """(batch, side, id) -> dense numbers in each batch, side 2 after side 1."""
    return nodes.select(group, "side", F.col("id").alias("old"), (F.row_number().over(W.partitionBy(group).orderBy("side", "id")) - 1).cast("long").alias("new"))


def sinkhorn(sim: DataFrame, reg: float = 1e-3, rounds: int = 300, tolerance: float = 1e-3, every: int = 5) -> DataFrame:
    """Doubly stochastic scaling of exp((minmax(score) - 1) / reg): rows sum to 1 / rows, columns to 1 / columns.

    In logarithms: each round updates the two potentials, each from a log-sum-exp over the cells. The cells are written once, in blocks of whole
    rows; a round is one pass over them that gives each block's part of the columns' sums. The columns' potentials, one number a column, go with the tasks."""
    from kinmap.operators.storage import store

    own = store(coalesced(sim).filter("score is not null"))
    columns = own.select("trg").distinct().toPandas()["trg"].sort_values().to_numpy()  # one number for each column
    low, high, n = own.agg(F.min("score"), F.max("score"), F.count_distinct("src")).first()
    m = len(columns)
    if not n:
        return sim
    count = max(1, math.ceil(own.count() / (1 << 18)))
    kinds = {f.name: f.dataType.simpleString() for f in sim.schema}
    packed = own.groupBy("src").agg(F.collect_list("trg").alias("t"), F.collect_list("score").alias("s")).repartition(count, "src")

    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            k = [((np.asarray(x, float) - low) / (high - low + 1e-8) - 1) / reg for x in f.s]
            yield pd.DataFrame({"src": f.src, "j": [np.searchsorted(columns, np.asarray(t)).astype("int32") for t in f.t], "k": k})

    blocks = store(packed.mapInPandas(prepare, f"src {kinds['src']}, j array<int>, k array<double>"))

    def rows_of(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate(f.j.to_list()), np.concatenate(f.k.to_list()), np.cumsum([0, *map(len, f.j)])[:-1]

    def potential(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Minus the log of each row's sum of exp(x), and of the number of rows."""
        top = np.maximum.reduceat(x, starts)
        sizes = np.diff(np.append(starts, len(x)))
        return -math.log(n) - top - np.log(np.add.reduceat(np.exp(x - np.repeat(top, sizes)), starts))

    def column_potentials(v: np.ndarray) -> np.ndarray:
        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top, total = np.full(m, -np.inf), np.zeros(m)
            for f in frames:
                if len(f):
                    j, k, starts = rows_of(f)
                    x = k + np.repeat(potential(k + v[j], starts), np.diff(np.append(starts, len(k))))
                    new = top.copy()
                    np.maximum.at(new, j, x)
                    total *= np.exp(np.where(np.isfinite(top), top - new, 0.0))
                    top = new
                    total += np.bincount(j, np.exp(x - top[j]), m)
            for at in range(0, m, 4096):
                yield pd.DataFrame({"c": [at], "top": [top[at : at + 4096]], "total": [total[at : at + 4096]]})

        def merged(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            tops, totals = np.stack(f.top.to_list()), np.stack(f.total.to_list())
            top = tops.max(axis=0)
            return pd.DataFrame({"c": [key[0]], "v": [-math.log(m) - top - np.log((totals * np.exp(tops - top)).sum(axis=0))]})

        parts = blocks.mapInPandas(part, "c long, top array<double>, total array<double>").groupBy("c").applyInPandas(merged, "c long, v array<double>")
        return np.concatenate([np.asarray(r.v) for r in sorted(parts.collect(), key=lambda r: r.c)])

    def deviation(before: np.ndarray, v: np.ndarray) -> float:
        def far(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    j, k, starts = rows_of(f)
                    yield pd.DataFrame({"d": [np.abs(np.expm1(potential(k + before[j], starts) - potential(k + v[j], starts))).max()]})

        return blocks.mapInPandas(far, "d double").agg(F.max("d")).first()[0]

    v = np.zeros(m)
    for i in range(rounds):
        before, v = v, column_potentials(v)
        if ((i + 1) % every == 0 or i + 1 == rounds) and deviation(before, v) <= tolerance:
            break

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 256):
                part = f.iloc[at : at + 256]
                j, k, starts = rows_of(part)
                sizes = np.diff(np.append(starts, len(k)))
                u = np.repeat(potential(k + before[j], starts), sizes)
                yield pd.DataFrame({"src": np.repeat(part.src.to_numpy(), sizes), "trg": columns[j], "score": np.exp(k + u + v[j])})

    return blocks.mapInPandas(cells, f"src {kinds['src']}, trg {kinds['trg']}, score double")
