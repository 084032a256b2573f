"""Column expressions on vectors, all in double precision and left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    def term(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def distance(a: Column, b: Column, metric: str) -> Column:
    """ip: one minus the inner product; l2: squared."""
    if metric == "ip":
        return F.lit(1.0) - inner_product(a, b)
    if metric == "l2":
        return squared_l2(a, b)
    raise ValueError(f"metric is ip or l2, not {metric}")


def ip_from_l2(norm_a: Column, norm_b: Column, l2: Column) -> Column:
    return (norm_a + norm_b - l2) / 2


def part(vec: Column, m: int, width: int) -> Column:
    """The m-th slice of a vector, from 0."""
    return F.slice(vec, m * width + 1, width)


def scaled(row: Column, factor: Column) -> Column:
    return F.transform(row, lambda x: x.cast("double") * factor)
