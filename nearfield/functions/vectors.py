"""Distances and scores of dense vectors as column expressions.

Vectors are arrays of any number type; sums are in double precision.  A null
vector, or two of unlike lengths, give null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    terms = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def sq_euclidean(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sq_euclidean(a, b))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """One less the cosine of the angle; null for a zero vector."""
    return 1 - inner_product(a, b) / F.nullif(F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b)), F.lit(0.0))


#: Name to column expression; smaller is nearer, so an inner product counts negated.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": euclidean,
    "squared_euclidean": sq_euclidean,
    "cosine": cosine,
    "inner_product": lambda a, b: -inner_product(a, b),
}


def metric(name: str) -> Callable[[Column, Column], Column]:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name]


def _in_order(a: np.ndarray, b: np.ndarray, f: Callable) -> np.ndarray:
    """Sum of f over the coordinates, one after the other, as a fold over an array adds them up."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for k in range(a.shape[-1]):
        out += f(a[..., k], b[..., k])
    return out


def pair_distances(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of rows to the rows beside them."""
    product = lambda x, y: x * y
    if name in ("euclidean", "squared_euclidean"):
        d = _in_order(a, b, lambda x, y: (x - y) * (x - y))
        return np.sqrt(d) if name == "euclidean" else d
    dot = _in_order(a, b, product)
    if name == "inner_product":
        return -dot
    return 1 - dot / (np.sqrt(_in_order(a, a, product)) * np.sqrt(_in_order(b, b, product)))


def recall(found: Column, truth: Column) -> Column:
    """Share of common ids among the first of both, as many as the shorter has; null where one is empty."""
    n = F.least(F.size(found), F.size(truth))
    both = F.size(F.array_intersect(F.slice(found, 1, n), F.slice(truth, 1, n)))
    return F.when(n > 0, both / n)
