"""Vectors as array<double> columns: JVM-side higher-order functions, no Python in the row path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row; a lambda over elements would compute it for each of them."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: str | Column) -> Column:
    """L2-normalised; a zero vector gives nulls and no error."""
    v = F.col(v) if isinstance(v, str) else v
    return bound(norm(v), lambda n: F.transform(v, lambda x: F.try_divide(x, n)))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - cosine of two unit vectors."""
    return 1.0 - dot(a, b)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def shares(v: str | Column, eps: float = 1e-6) -> Column:
    """Non-negative entries as a distribution, smoothed."""
    v = F.col(v) if isinstance(v, str) else v
    return bound(total(F.transform(v, lambda x: x + eps)), lambda s: F.transform(v, lambda x: (x + eps) / s))


def kl(p: str | Column, q: str | Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: x * F.ln(x / y)))


def padded(v: Column, width: int) -> Column:
    """Zeros up to a fixed width."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(v), F.lit(0)).cast("int")))


def number_or_null(c: str | Column) -> Column:
    """NaN means "no score"; in Spark that is NULL, else NaN would compare above every threshold."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), None).otherwise(c)


def layer(vectors: Column, names: Column, name: Column | int | str) -> Column:
    """The vector of the named layer; null if there is none of that name."""
    at = F.array_position(names, name if isinstance(name, Column) else F.lit(name))
    return F.when(at > 0, F.try_element_at(vectors, at.cast("int")))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; zeros if none is."""
    weight = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double"))
    zero = F.transform(tokens[0], lambda _: F.lit(0.0))
    added = F.aggregate(F.arrays_zip(tokens.alias("t"), mask.alias("m")), zero, lambda a, z: F.zip_with(a, z["t"], lambda x, y: x + y * z["m"].cast("double")))
    return bound(F.greatest(weight, F.lit(1.0)), lambda w: F.transform(added, lambda x: x / w))


def last_token(tokens: Column, mask: Column) -> Column:
    """The vector of the last token whose mask is 1; padding may be on either side."""
    at = F.array_max(F.transform(mask, lambda m, i: F.when(m == 1, i + 1)))
    return F.when(at.isNotNull(), F.try_element_at(tokens, at.cast("int")))


def mean_or(rows: Column, weights: Column, otherwise: Column) -> Column:
    """Weighted mean of vectors; ``otherwise`` where there are none, or no weight."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    zero = F.transform(rows[0], lambda _: F.lit(0.0))
    added = F.aggregate(F.arrays_zip(rows.alias("v"), weights.alias("w")), zero, lambda a, z: F.zip_with(a, z["v"], lambda x, y: x + y * z["w"]))
    return F.when((F.size(rows) > 0) & (total > 0), F.transform(added, lambda x: x / total)).otherwise(otherwise)
