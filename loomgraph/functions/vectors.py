"""Vector functions over array<double> columns, as expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8  # fixed value: below this a squared distance counts as this


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def translate(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def complex_product(a: Column, b: Column) -> Column:
    """Halves are real and imaginary parts."""
    half = F.floor(F.size(a) / 2).cast("int")
    re = lambda v: F.slice(v, F.lit(1), half)
    im = lambda v: F.slice(v, half + 1, F.size(v) - half)
    minus = F.zip_with(hadamard(re(a), re(b)), hadamard(im(a), im(b)), lambda x, y: x - y)
    return F.concat(minus, translate(hadamard(re(a), im(b)), hadamard(im(a), re(b))))


def dot(a: Column, b: Column) -> Column:
    return total(hadamard(a, b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))), F.lit(NORM_FLOOR)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """True cosine; 0 where a vector is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def scale(a: Column, c: Column | float) -> Column:
    return F.transform(a, lambda x: x * c)


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def sigmoid(a: Column) -> Column:
    return F.transform(a, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


ACTIVATIONS = {"relu": relu, "sigmoid": sigmoid, "none": lambda a: a}


def argmax(a: Column) -> Column:
    """Position, from 0, of the first greatest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def sum_of_vectors(name: str, dim: int) -> Column:
    """Aggregate: the sum of vectors of a group, as one sum a component, so it is combined on the map side."""
    return F.array(*[F.sum(F.col(name)[i]) for i in range(dim)])


def max_of_vectors(name: str, dim: int) -> Column:
    return F.array(*[F.max(F.col(name)[i]) for i in range(dim)])
