"""Optimizer steps on vectors, and sparse updates of node tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import vectors as V
from loomgraph.functions.hashing import unit
from loomgraph.operators.scoring import gathered

SPARSE_EPS = 1e-10  # fixed value of the sparse update


def sgd(p: Column, g: Column, lr: float) -> Column:
    return F.zip_with(p, g, lambda x, y: x - lr * y)


def adagrad(p: Column, g: Column, s: Column, lr: float, eps: float = 1e-10, steps: int = 0, decay: float = 0.0, weight_decay: float = 0.0) -> tuple[Column, Column]:
    """New parameters and new sums of squares."""
    rate = lr / (1 + steps * decay)
    g = F.zip_with(g, p, lambda y, x: y + weight_decay * x) if weight_decay else g
    new_s = F.zip_with(s, g, lambda a, y: a + y * y)
    step = F.zip_with(g, new_s, lambda y, a: rate * y / (F.sqrt(a) + eps))
    return F.zip_with(p, step, lambda x, d: x - d), new_s


def adam(p: Column, g: Column, m: Column, v: Column, lr: float, step: int = 1, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, amsgrad: Column | None = None, weight_decay: float = 0.0) -> tuple[Column, Column, Column, Column]:
    """New parameters, first and second moments, and greatest second moments, bias-corrected for `step` from 1."""
    g = F.zip_with(g, p, lambda y, x: y + weight_decay * x) if weight_decay else g
    new_m = F.zip_with(m, g, lambda a, y: b1 * a + (1 - b1) * y)
    new_v = F.zip_with(v, g, lambda a, y: b2 * a + (1 - b2) * y * y)
    top = F.zip_with(amsgrad, new_v, lambda a, b: F.greatest(a, b)) if amsgrad is not None else new_v
    move = F.zip_with(new_m, top, lambda a, b: (lr / (1 - b1**step)) * a / (F.sqrt(b) / (1 - b2**step) ** 0.5 + eps))
    return F.zip_with(p, move, lambda x, d: x - d), new_m, new_v, top


def summed(updates: DataFrame, dim: int, key: str = "id", value: str = "grad") -> DataFrame:
    """(id, grad): updates of equal ids added up, combined on the map side."""
    return updates.groupBy(key).agg(V.sum_of_vectors(value, dim).alias(value))


def add_updates(nodes: DataFrame, deltas: DataFrame, dim: int) -> DataFrame:
    """(id, vec) with the sum of deltas (id, grad) added; ids without one stay."""
    both = nodes.join(summed(deltas, dim), "id", "left")
    return both.select("id", F.when(F.col("grad").isNull(), F.col("vec")).otherwise(V.translate(F.col("vec"), F.col("grad"))).alias("vec"))


def put_rows(base: DataFrame, new: DataFrame) -> DataFrame:
    """(id, vec) of base, overwritten where new has the id."""
    return base.select("id", "vec").join(new.select("id", F.col("vec").alias("new")), "id", "left").select("id", F.coalesce("new", "vec").alias("vec"))


def sparse_adagrad(nodes: DataFrame, grads: DataFrame, lr: float, dim: int) -> DataFrame:
    """(id, vec, state) after one update of the nodes in grads (id, grad; repeats are added up); all others stay."""
    both = nodes.select("id", "vec", "state").join(summed(grads, dim), "id", "left")
    p, s = adagrad(F.col("vec"), F.col("grad"), F.col("state"), lr, SPARSE_EPS)
    touched = F.col("grad").isNotNull()
    return both.select("id", F.when(touched, p).otherwise(F.col("vec")).alias("vec"), F.when(touched, s).otherwise(F.col("state")).alias("state"))


def distmult_mse_gradients(edges: DataFrame, nodes: DataFrame, rels: DataFrame, target: Column | None = None) -> DataFrame:
    """(id, grad): of (score - target)^2 by src and dst vectors, one row an end."""
    g = gathered(edges, nodes, rels)
    c = 2 * (V.dot(V.hadamard(F.col("vs"), F.col("vr")), F.col("vd")) - (F.lit(1.0) if target is None else target))
    g = g.withColumn("c", c)
    ends = F.array(
        F.struct(F.col("src").alias("id"), V.scale(V.hadamard(F.col("vr"), F.col("vd")), F.col("c")).alias("grad")),
        F.struct(F.col("dst").alias("id"), V.scale(V.hadamard(F.col("vs"), F.col("vr")), F.col("c")).alias("grad")),
    )
    return g.select(F.explode(ends).alias("x")).select("x.*")


def initial_vectors(ids: DataFrame, dim: int, limit: float, seed: int = 0) -> DataFrame:
    """(id, vec, state): values in [-limit, limit) by hash, and zero state."""
    vec = F.array(*[(unit(seed, "id", F.lit(j)) * 2 - 1) * limit for j in range(dim)])
    return ids.select("id", vec.alias("vec"), F.array_repeat(F.lit(0.0), dim).alias("state"))


def glorot_limit(fan_in: int, fan_out: int) -> float:
    return (6 / (fan_in + fan_out)) ** 0.5


def fans(shape: tuple[int, ...]) -> tuple[int, int]:
    if not shape:
        return 1, 1
    if len(shape) == 1:
        return shape[0], shape[0]
    return shape[-2], shape[-1]


def normal_vectors(ids: DataFrame, dim: int, mean: float, std: float, seed: int = 0) -> DataFrame:
    """(id, vec): normal values by hash, from two even ones each."""
    one = lambda j: mean + std * F.sqrt(-2 * F.log(1 - unit(seed, "id", F.lit(f"{j}u")))) * F.cos(unit(seed, "id", F.lit(f"{j}v")) * (2 * math.pi))
    return ids.select("id", F.array(*[one(j) for j in range(dim)]).alias("vec"))


def constant_vectors(ids: DataFrame, dim: int, value: float) -> DataFrame:
    return ids.select("id", F.array_repeat(F.lit(float(value)), dim).alias("vec"))


def dropout(nodes: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """(id, vec) with components set to 0 with probability `rate` by hash, and the others scaled up; for training only."""
    keep = lambda x, j: F.when(unit(seed, "id", j) >= rate, x / (1 - rate)).otherwise(F.lit(0.0))
    return nodes.select("id", F.transform("vec", keep).alias("vec"))


def unsound(nodes: DataFrame, low: float, high: float) -> DataFrame:
    """One row: vectors with NaN, with negative components, and with components outside [low, high]."""
    count = lambda test: F.sum(F.exists("vec", test).cast("bigint"))
    return nodes.agg(count(lambda x: F.isnan(x)).alias("n_nan"), count(lambda x: x < 0).alias("n_negative"), count(lambda x: (x < low) | (x > high)).alias("n_outside"))
