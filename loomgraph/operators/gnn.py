"""Graph network layers as joins and aggregates; matrix products run in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import vectors as V
from loomgraph.functions.hashing import unit


def hash_matrix(seed: int | str, rows: int, cols: int, limit: float) -> np.ndarray:
    """A matrix of values in [-limit, limit) that depends on the seed only."""
    u = [[int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:8], 16) / 4294967296.0 for j in range(cols)] for i in range(rows)]
    return (np.array(u) * 2 - 1) * limit


def product(w: np.ndarray, c: str | Column, bias: np.ndarray | None = None) -> Column:
    """W @ vector (+ bias) of each row."""

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        out = np.stack(v.to_numpy()) @ w.T if len(v) else np.zeros((0, w.shape[0]))
        return pd.Series(list(out if bias is None else out + bias))

    return apply(c)


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """(center, nbr): each edge seen from both of its ends."""
    ends = F.array(F.struct(F.col("src").alias("center"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("center"), F.col("src").alias("nbr")))
    return edges.select(F.explode(ends).alias("x")).select("x.*")


def segment(pairs: DataFrame, nodes: DataFrame, dim: int, how: str = "sum") -> DataFrame:
    """(center, agg, n): sum, mean or max of the neighbours' vectors; partials are combined before the shuffle, so hubs don't matter."""
    found = pairs.join(nodes.select(F.col("id").alias("nbr"), "vec"), "nbr")
    value = V.max_of_vectors("vec", dim) if how == "max" else V.sum_of_vectors("vec", dim)
    out = found.groupBy("center").agg(value.alias("agg"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("agg", V.scale(F.col("agg"), F.lit(1.0) / F.col("n"))) if how == "mean" else out


def _zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def _with_segment(nodes: DataFrame, agg: DataFrame, dim: int) -> DataFrame:
    return nodes.select("id", "vec").join(agg.withColumnRenamed("center", "id"), "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("agg", F.coalesce("agg", _zeros(dim)))


def sage_mean(nodes: DataFrame, pairs: DataFrame, w_self: np.ndarray, w_nbr: np.ndarray) -> DataFrame:
    """(id, vec): W1 h + W2 mean of neighbours; without neighbours W1 h."""
    dim = w_self.shape[1]
    both = _with_segment(nodes, segment(pairs, nodes, dim), dim).withColumn("mean", V.scale(F.col("agg"), F.lit(1.0) / F.greatest("n", F.lit(1))))
    return both.select("id", V.translate(product(w_self, "vec"), product(w_nbr, "mean")).alias("vec"))


def sage_gcn(nodes: DataFrame, pairs: DataFrame, w: np.ndarray) -> DataFrame:
    """(id, vec): W (h + sum of neighbours) / (n + 1)."""
    both = _with_segment(nodes, segment(pairs, nodes, w.shape[1]), w.shape[1])
    return both.select("id", V.scale(V.translate(F.col("vec"), F.col("agg")), F.lit(1.0) / (F.col("n") + 1)).alias("x")).select("id", product(w, "x").alias("vec"))


def gcn(nodes: DataFrame, pairs: DataFrame, w: np.ndarray, bias: np.ndarray | None = None) -> DataFrame:
    """(id, vec): W ((sum h_j / sqrt(deg_j + 1) + h / sqrt(n + 1)) / sqrt(n + 1)) + b; degrees are those in pairs."""
    dim = w.shape[1]
    deg = pairs.groupBy(F.col("center").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    scaled = nodes.join(deg, "id", "left").select("id", V.scale(F.col("vec"), 1.0 / F.sqrt(F.coalesce("deg", F.lit(0)) + 1.0)).alias("vec"))
    both = _with_segment(scaled, segment(pairs, scaled, dim), dim)
    return both.select("id", V.scale(V.translate(F.col("vec"), F.col("agg")), 1.0 / F.sqrt(F.col("n") + 1.0)).alias("x")).select("id", product(w, "x", bias).alias("vec"))


def rgcn(nodes: DataFrame, edges: DataFrame, w_rel: Sequence[np.ndarray], w_self: np.ndarray) -> DataFrame:
    """(id, vec): sum over outgoing edges of W_rel h_j, by max(1, n_out), plus W h. Vectors are summed by relation before the product."""
    dim, out = w_self.shape[1], w_self.shape[0]
    found = edges.select(F.col("src").alias("center"), "rel", F.col("dst").alias("nbr")).join(nodes.select(F.col("id").alias("nbr"), "vec"), "nbr")
    by_rel = found.groupBy("center", "rel").agg(V.sum_of_vectors("vec", dim).alias("vec"), F.count(F.lit(1)).alias("n"))
    stack = np.stack(w_rel)

    @F.pandas_udf("array<double>")
    def through(rel: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(list(np.einsum("nij,nj->ni", stack[rel.to_numpy()], np.stack(v.to_numpy()))) if len(v) else [])

    sums = by_rel.withColumn("vec", through("rel", "vec")).groupBy("center").agg(V.sum_of_vectors("vec", out).alias("agg"), F.sum("n").alias("n"))
    both = _with_segment(nodes, sums, out)
    return both.select("id", V.translate(V.scale(F.col("agg"), F.lit(1.0) / F.greatest("n", F.lit(1))), product(w_self, "vec")).alias("vec"))


def attention_softmax(logits: DataFrame) -> DataFrame:
    """Append alpha to (center, ..., logit): softmax within each center. Maxima and sums are aggregated, not windowed, so a hub is no single task."""
    top = logits.groupBy("center").agg(F.max("logit").alias("m"))
    shifted = logits.join(top, "center").withColumn("e", F.exp(F.col("logit") - F.col("m")))
    sums = shifted.groupBy("center").agg(F.sum("e").alias("s"))
    return shifted.join(sums, "center").withColumn("alpha", F.col("e") / F.col("s")).drop("m", "e", "s")


def with_self(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    return pairs.select("center", "nbr").unionByName(nodes.select(F.col("id").alias("center"), F.col("id").alias("nbr")))


def gat(nodes: DataFrame, pairs: DataFrame, heads: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], slope: float = 0.2, average: bool = True, input_dropout: float = 0.0, attention_dropout: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, vec): per head (W, a_l, a_r), the neighbours' and the node's own W h, weighted by softmax of LeakyReLU(a_l W h_i + a_r W h_j); heads are averaged or put side by side.

    LeakyReLU is monotone, so the greatest logit of a center follows from its neighbours' greatest right part, one
    number; the vectors are joined once, and weights and weighted vectors are summed together. For training, components
    of the input and weights of neighbours are dropped by hash, with rates of their own, and the others scaled up.
    """
    out = heads[0][0].shape[0]
    if input_dropout:
        nodes = nodes.select("id", F.transform("vec", lambda x, j: F.when(unit(f"{seed}:in", "id", j) >= input_dropout, x / (1 - input_dropout)).otherwise(F.lit(0.0))).alias("vec"))
    parts = []
    links = with_self(nodes, pairs)
    leaky = lambda x: F.when(x > 0, x).otherwise(x * slope)
    for k, (w, left, right) in enumerate(heads):
        h = nodes.select("id", product(w, "vec").alias("h")).select("id", "h", product(np.stack([left, right]), "h").alias("lr")).select("id", "h", F.col("lr")[0].alias("l"), F.col("lr")[1].alias("r"))
        top = links.join(h.select(F.col("id").alias("nbr"), "r"), "nbr").groupBy("center").agg(F.max("r").alias("top")).join(h.select(F.col("id").alias("center"), "l"), "center")
        pair = links.join(top, "center").join(h.select(F.col("id").alias("nbr"), "h", "r"), "nbr")
        e = pair.withColumn("e", F.exp(leaky(F.col("l") + F.col("r")) - leaky(F.col("l") + F.col("top")))).select("center", "nbr", "e", "h")
        kept = F.when(unit(f"{seed}:{k}", "center", "nbr") >= attention_dropout, F.col("e") / (1 - attention_dropout)).otherwise(F.lit(0.0)) if attention_dropout else F.col("e")
        e = e.select("center", "e", V.scale(F.col("h"), kept).alias("h"))
        sums = e.groupBy("center").agg(V.sum_of_vectors("h", out).alias("h"), F.sum("e").alias("e"))
        parts.append(sums.select("center", V.scale(F.col("h"), 1.0 / F.col("e")).alias(f"h{k}")))
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.join(p, "center")
    if not average:
        return joined.select(F.col("center").alias("id"), F.concat(*[F.col(f"h{k}") for k in range(len(heads))]).alias("vec"))
    total = F.col("h0")
    for k in range(1, len(heads)):
        total = V.translate(total, F.col(f"h{k}"))
    return joined.select(F.col("center").alias("id"), V.scale(total, 1.0 / len(heads)).alias("vec"))


def slice_layer(nodes: DataFrame, offset: int, dim: int) -> DataFrame:
    """Embedding and feature layers: columns [offset, offset + dim) of the vectors."""
    return nodes.select("id", F.slice("vec", offset + 1, dim).alias("vec"))


def concat_layer(*inputs: DataFrame) -> DataFrame:
    out = inputs[0].select("id", F.col("vec").alias("v0"))
    for k, x in enumerate(inputs[1:], 1):
        out = out.join(x.select("id", F.col("vec").alias(f"v{k}")), "id")
    return out.select("id", F.concat(*[F.col(f"v{k}") for k in range(len(inputs))]).alias("vec"))


def linear_layer(w: np.ndarray, *inputs: DataFrame) -> DataFrame:
    return concat_layer(*inputs).select("id", product(w, "vec").alias("vec"))


def post(nodes: DataFrame, bias: np.ndarray | None = None, activation: str = "none") -> DataFrame:
    """Bias, then activation."""
    v = F.col("vec") if bias is None else V.translate(F.col("vec"), F.array(*[F.lit(float(x)) for x in bias]))
    return nodes.select("id", V.ACTIVATIONS[activation](v).alias("vec"))


def encode(nodes: DataFrame, layers: Sequence[Callable[[DataFrame, DataFrame], DataFrame]], pairs_of_layer: Callable[[int], DataFrame]) -> DataFrame:
    """Fold layers over node vectors; pairs_of_layer(k) gives the neighbour pairs that layer k (from 1) may use."""
    for k, layer in enumerate(layers, 1):
        nodes = layer(nodes, pairs_of_layer(k))
    return nodes
