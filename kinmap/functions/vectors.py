"""Column expressions over ARRAY<DOUBLE> vectors: no Python in the row path."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scaled(a: Column, by) -> Column:
    return F.transform(a, lambda x: x * by)


def dot(a: Column, b: Column) -> Column:
    return total(times(a, b))


def norm(a: Column, p: int = 2) -> Column:
    return total(F.transform(a, F.abs)) if p == 1 else F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    d = minus(a, b)
    return dot(d, d)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine similarity; each norm counts as ``eps`` at least."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda's argument, where a plain expression would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def unit(a: Column, eps: float = 1e-5) -> Column:
    """x / (|x| + eps)."""
    return let(a, lambda v: let(norm(v) + F.lit(eps), lambda n: F.transform(v, lambda x: x / n)))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """inner, cosine, euclidean (1 - distance), manhattan (1 - distance), sqeuclidean (1 - squared distance)."""
    if metric == "inner":
        return dot(a, b)
    if metric == "cosine":
        return cosine(a, b)
    if metric == "euclidean":
        return F.lit(1.0) - F.sqrt(squared_distance(a, b))
    if metric == "manhattan":
        return F.lit(1.0) - norm(minus(a, b), 1)
    if metric == "sqeuclidean":
        return F.lit(1.0) - squared_distance(a, b)
    raise ValueError(f"unknown metric {metric}")


def linear(a: Column, matrix: list[list[float]]) -> Column:
    """matrix @ a, for a small matrix given row by row."""
    return F.array(*[dot(a, F.array(*map(F.lit, row))) for row in matrix])


def half(a: Column, which: int, of: int = 2) -> Column:
    """The ``which``-th of ``of`` equal parts, from 0."""
    n = (F.size(a) / of).cast("int")
    return F.slice(a, F.lit(1) + n * which, n)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


# Scores of triples from gathered vectors. Where not said otherwise, higher is better.


def align(e1: Column, e2: Column, p: int = 2) -> Column:
    return -norm(minus(e1, e2), p)


def translate(e1: Column, r: Column, e2: Column, p: int = 2, normalize: bool = False) -> Column:
    """-|e1 + r - e2|; ``normalize`` scales the entity vectors to length one first."""
    if normalize:
        e1, e2 = unit(e1, 1e-12), unit(e2, 1e-12)
    return -norm(minus(plus(e1, r), e2), p)


def neighbour_align(e1: Column, e2: Column, n1: Column, n2: Column, beta: float = 0.5) -> Column:
    return F.lit(beta) * sigmoid(cosine(n1, n2, 1e-6)) + F.lit(1 - beta) * sigmoid(cosine(e1, e2, 1e-6))


def mapped_align(e1: Column, e2: Column, p: int = 2, shift: Column | None = None, matrix: list[list[float]] | None = None) -> Column:
    """Align after a shift of e1 or a row-vector product e1 @ matrix."""
    if shift is not None:
        e1 = plus(e1, shift)
    if matrix is not None:
        e1 = linear(e1, [list(c) for c in zip(*matrix, strict=True)])
    return align(e1, e2, p)


def squared_translate(e1: Column, r: Column, e2: Column) -> Column:
    """A distance: lower is better."""
    return squared_distance(plus(e1, r), e2)


def edge_translate(e1: Column, r: Column, e2: Column, context: Column, p: int = 2) -> Column:
    """The relation, less its part along the unit vector of ``context``, through tanh; then the distance |e1 + psi - e2|."""
    psi = let(unit(context, 1e-12), lambda h: let(dot(r, h), lambda along: F.zip_with(r, h, lambda x, y: F.tanh(x - along * y))))
    return -translate(e1, psi, e2, p)


def edge_translate_by_ends(e1: Column, r: Column, e2: Column, weights: list[list[float]], bias: list[float], p: int = 2) -> Column:
    """As ``edge_translate``, the context being made of both ends by a layer tanh(weights @ [e1, e2] + bias)."""
    layer = lambda ends: F.array(*[F.tanh(dot(ends, F.array(*map(F.lit, row))) + F.lit(b)) for row, b in zip(weights, bias, strict=True)])
    return let(F.concat(e1, e2), lambda ends: let(layer(ends), lambda context: edge_translate(e1, r, e2, context, p)))


def edge_translate_by_edges(e1: Column, r: Column, e2: Column, layers: list[tuple[list[list[float]], list[float]]], p: int = 2) -> Column:
    """The relation in the context of its compressed edges: unit layers of [e1, r] and of [r, e2], joined, of length one, through a third
    layer and tanh; then the distance |e1 + psi - e2|. Layers are tanh(weights @ x + bias), their outputs of length one."""

    def layer(x: Column, which: int) -> Column:
        weights, bias = layers[which]
        return let(x, lambda v: unit(F.array(*[F.tanh(dot(v, F.array(*map(F.lit, row))) + F.lit(b)) for row, b in zip(weights, bias, strict=True)]), 1e-12))

    crossed = unit(F.concat(layer(F.concat(e1, r), 1), layer(F.concat(r, e2), 2)), 1e-12)
    return let(layer(crossed, 0), lambda psi: -translate(e1, F.transform(psi, F.tanh), e2, p))


def masked_pool(rows: Column, n: Column, how: str = "max") -> Column:
    """Element-wise maximum or mean of the first ``n`` of an array of vectors; what is behind them, padding, doesn't count. No vector: null."""
    own = F.slice(rows, F.lit(1), F.greatest(n, F.lit(0)))
    if how == "max":
        best = F.aggregate(own, F.element_at(own, 1), lambda s, v: F.zip_with(s, v, lambda x, y: F.greatest(x, y)))
        return F.when(F.size(own) > 0, best)
    if how == "mean":
        total_ = F.aggregate(own, F.transform(F.element_at(own, 1), lambda x: x * 0), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
        return F.when(F.size(own) > 0, F.transform(total_, lambda x: x / F.size(own)))
    raise ValueError(f"unknown pooling {how}")


def weighted_concat(parts: list[tuple[Column, float]]) -> Column:
    """Vectors of length one each, times their weights, one after the other: inner products are the weighted sums of the parts'."""
    return F.concat(*[scaled(unit(v, 1e-12), w**0.5) for v, w in parts])


def distma(e1: Column, r: Column, e2: Column) -> Column:
    return dot(e1, r) + dot(e1, e2) + dot(r, e2)


def complex_product(e1: Column, r: Column, e2: Column) -> Column:
    """Real part of the trilinear product with the conjugate of e2; first halves are real, second imaginary."""
    (a, b), (c, d), (e, f) = ((half(x, 0), half(x, 1)) for x in (e1, r, e2))
    return dot(times(a, c), e) + dot(times(a, d), f) + dot(times(b, c), f) - dot(times(b, d), e)


def multi_view(e1: Column, r: Column, e2: Column) -> Column:
    """Array of: distma of the first halves, complex product of the second, their sum."""
    x = distma(half(e1, 0), half(r, 0), half(e2, 0))
    y = complex_product(half(e1, 1), half(r, 1), half(e2, 1))
    return F.array(x, y, x + y)


def hyperplane_translate(e1: Column, r: Column, e2: Column, normal: Column, p: int = 2) -> Column:

    def flat(e: Column, w: Column) -> Column:
        return let(dot(e, w), lambda along: F.zip_with(e, w, lambda x, y: x - along * y))

    return let(unit(normal, 1e-12), lambda w: translate(flat(e1, w), r, flat(e2, w), p))


def projected_translate(e1: Column, r: Column, e2: Column, matrix: Column, p: int = 2) -> Column:
    """matrix: array of rows; both entities are multiplied by it."""
    put = lambda e: F.transform(matrix, lambda row: dot(row, e))
    return translate(put(e1), r, put(e2), p)


def bilinear(e1: Column, r: Column, e2: Column) -> Column:
    return dot(times(e1, r), e2)


def rotate(e1: Column, r: Column, e2: Column, phase_range: float) -> Column:
    """Sum of the moduli of e1 turned by r, less e2: a distance. r is a phase of half the size, scaled by pi / phase_range."""
    angle = scaled(r, math.pi / phase_range)
    a, b, e, f = half(e1, 0), half(e1, 1), half(e2, 0), half(e2, 1)
    c, s = F.transform(angle, F.cos), F.transform(angle, F.sin)
    re = minus(minus(times(a, c), times(b, s)), e)
    im = minus(plus(times(a, s), times(b, c)), f)
    return total(F.zip_with(re, im, lambda x, y: F.sqrt(x * x + y * y)))


def hake(e1: Column, r: Column, e2: Column, phase_range: float, phase_weight: float | None = None, modulus_weight: float = 1.0) -> Column:
    """Phase and modulus distance. Entities: phase, modulus; relation: phase, modulus, bias."""
    turn = math.pi / phase_range
    weight = 0.5 * phase_range if phase_weight is None else phase_weight
    phase = scaled(minus(plus(half(e1, 0), half(r, 0, 3)), half(e2, 0)), turn)
    m = F.transform(half(r, 1, 3), F.abs)
    bias = F.zip_with(half(r, 2, 3), m, lambda b, x: F.greatest(F.least(b, F.lit(1.0)), -x))
    head = times(half(e1, 1), plus(m, bias))
    tail = F.zip_with(half(e2, 1), bias, lambda x, b: x * (F.lit(1.0) - b))
    return total(F.transform(phase, lambda x: F.abs(F.sin(x / 2)))) * weight + norm(minus(head, tail)) * modulus_weight
