"""Training of link and class models: batches with negatives, gradients, sparse updates, versions to resume from."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import vectors as V
from loomgraph.functions.hashing import draw
from loomgraph.operators import scoring
from loomgraph.operators.optim import SPARSE_EPS, adagrad
from loomgraph.operators.order import hash_positions, with_batches
from loomgraph.session import BROADCAST_BYTES, discard, spread, written
from loomgraph.sources.sinks import latest_state, save_state

LOSSES = ("softmax_ce", "cross_entropy", "ranking", "bce_sigmoid", "bce_logits", "mse", "softplus")
GRADIENT = "kind string, id bigint, grad array<double>"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def loss_slopes(loss: str, p: np.ndarray, n: np.ndarray, margin: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the summed loss by the edges' scores p (rows) and their negatives' scores n (rows by negatives)."""
    if loss in ("softmax_ce", "cross_entropy"):
        m = np.maximum(p, n.max(1, initial=-np.inf))
        a, b = np.exp(p - m), np.exp(n - m[:, None])
        total = a + b.sum(1)
        return a / total - 1, b / total[:, None]
    if loss == "ranking":
        over = (n - p[:, None] + margin > 0).astype(float)
        return -over.sum(1), over
    if loss in ("bce_sigmoid", "bce_logits"):
        return _sigmoid(p) - 1, _sigmoid(n)
    if loss == "mse":
        return 2 * (p - 1), 2 * n
    if loss == "softplus":
        return -_sigmoid(-p), _sigmoid(n)
    raise ValueError(f"no such loss: {loss}")


def _back(decoder: str, s: np.ndarray, r: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by s and r, given those by the query vector."""
    if decoder == "distmult":
        return g * r, g * s
    if decoder == "transe":
        return g, g
    h = s.shape[1] // 2
    conjugate = lambda x: np.concatenate([g[:, :h] * x[:, :h] + g[:, h:] * x[:, h:], g[:, h:] * x[:, :h] - g[:, :h] * x[:, h:]], 1)
    return conjugate(r), conjugate(s)


def slopes(decoder: str, loss: str, s: np.ndarray, r: np.ndarray, d: np.ndarray, n: np.ndarray, margin: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the summed loss by s, r, d (rows of edges) and by the negatives n that all of them share."""
    q = scoring.query_vectors(decoder, s, r)
    if decoder == "transe":
        to_d, to_n = q - d, q[:, None] - n[None]
        at_d, at_n = (np.sqrt(np.maximum((x * x).sum(-1), V.NORM_FLOOR)) for x in (to_d, to_n))
        gp, gn = loss_slopes(loss, -at_d, -at_n, margin)
        # the score is the negated distance; below the floor it doesn't change
        wp, wn = np.where(at_d**2 > V.NORM_FLOOR, gp / at_d, 0), np.where(at_n**2 > V.NORM_FLOOR, gn / at_n, 0)
        gd, each = wp[:, None] * to_d, wn[:, :, None] * to_n
        return *_back(decoder, s, r, -gd - each.sum(1)), gd, each.sum(0)
    gp, gn = loss_slopes(loss, (q * d).sum(1), q @ n.T, margin)
    return *_back(decoder, s, r, gp[:, None] * d + gn @ n), gp[:, None] * q, gn.T @ q


def link_gradients(batch: DataFrame, negatives: DataFrame, nodes: DataFrame, rels: DataFrame, decoder: str, loss: str, dim: int, margin: float = 0.1, rel_kind: str = "rel", slice_rows: int = 512) -> DataFrame:
    """(kind, id, grad): gradients of the summed loss of a batch of edges (src, rel, dst) by node and relation vectors, not yet added up across tasks.

    negatives (node) stand in for dst, the same ones for all edges of the batch; they are a parameter of the batch, so few, and go to
    every task. So do the tables of vectors if they are no larger than BROADCAST_BYTES; else each edge is joined with its vectors. The other side is had with swapped edges, inverse relations and a rel_kind of their own.
    """
    found = negatives.select("node").join(nodes.select(F.col("id").alias("node"), "vec"), "node").toArrow()
    order = np.argsort(np.asarray(found["node"]), kind="stable")
    node = np.asarray(found["node"], np.int64)[order]
    matrix = np.array(found["vec"].to_pylist(), np.float64).reshape(-1, dim)[order]

    def summed_up(src: np.ndarray, rel: np.ndarray, dst: np.ndarray, s: np.ndarray, r: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        gs, gr, gd, gn = slopes(decoder, loss, s, r, d, matrix, margin)
        for kind, ids, g in (("node", np.concatenate([src, dst, node]), np.concatenate([gs, gd, gn])), (rel_kind, rel, gr)):
            keys, where = np.unique(ids, return_inverse=True)
            total = np.zeros((len(keys), dim))
            np.add.at(total, where, g)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * dim, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), lists], names=["kind", "id", "grad"])

    edges = batch.select("src", F.col("rel").cast("bigint").alias("rel"), "dst")
    tables = [_sorted_matrix(df, key, dim) for df, key in ((nodes, "id"), (rels, "rel"))]
    if all(t is not None for t in tables):
        shared = batch.sparkSession.sparkContext.broadcast(tables)

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (ids, vectors), (rel_ids, rel_vectors) = shared.value
            for b in batches:
                ends = [np.asarray(b.column(k)) for k in range(3)]
                held = np.isin(ends[0], ids) & np.isin(ends[2], ids) & np.isin(ends[1], rel_ids)
                src, rel, dst = (x[held] for x in ends)
                for at in range(0, len(src), slice_rows):
                    x, y, z = (e[at : at + slice_rows] for e in (src, rel, dst))
                    yield from summed_up(x, y, z, vectors[np.searchsorted(ids, x)], rel_vectors[np.searchsorted(rel_ids, y)], vectors[np.searchsorted(ids, z)])

        return spread(edges.filter(F.col("src").isNotNull() & F.col("rel").isNotNull() & F.col("dst").isNotNull())).mapInArrow(looked_up, GRADIENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, slice_rows):
                part = b.slice(at, slice_rows)
                s, r, d = (np.asarray(part.column(k).flatten(), np.float64).reshape(-1, dim) for k in ("vs", "vr", "vd"))
                yield from summed_up(*(np.asarray(part.column(k)) for k in ("src", "rel", "dst")), s, r, d)

    g = scoring.gathered(edges, nodes, rels)
    return g.select("src", "rel", "dst", "vs", "vr", "vd").mapInArrow(run, GRADIENT)


def _sorted_matrix(df: DataFrame, key: str, dim: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids in order and their vectors, or None if they are more than every worker should get."""
    if df.count() * dim * 8 > BROADCAST_BYTES:
        return None
    found = df.select(F.col(key).cast("bigint").alias("k"), "vec").toArrow()
    ids = np.asarray(found["k"], np.int64)
    order = np.argsort(ids, kind="stable")
    values = pc.list_flatten(found["vec"]).combine_chunks()
    return ids[order], np.asarray(values, np.float64).reshape(-1, dim)[order]


def class_gradients(labelled: DataFrame, n_classes: int) -> DataFrame:
    """(id, grad): of cross entropy by the logits of (id, logits, y_true)."""
    m = F.array_max("logits")
    e = F.transform("logits", lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return labelled.select("id", F.transform(e, lambda x, j: x / total - F.when(j == F.col("y_true"), 1.0).otherwise(0.0)).alias("grad"))


@dataclass(frozen=True)
class Settings:
    """What a training run depends on. inverse: src is corrupted too, under inverse relations."""

    decoder: str = "distmult"
    loss: str = "softmax_ce"
    dim: int = 64
    lr: float = 0.1
    batch_edges: int = 10_000
    negatives: int = 100
    inverse: bool = True
    margin: float = 0.1
    seed: int = 0


@dataclass(frozen=True)
class Model:
    """nodes (id, vec, state) and rels (kind, id, vec, state) of kinds rel and inverse."""

    nodes: DataFrame
    rels: DataFrame

    def rel_vectors(self, kind: str = "rel") -> DataFrame:
        return self.rels.filter(F.col("kind") == kind).select(F.col("id").alias("rel"), "vec")

    @property
    def node_vectors(self) -> DataFrame:
        return self.nodes.select("id", "vec")


def _stepped(table: DataFrame, grads: DataFrame, keys: list[str], lr: float) -> DataFrame:
    """Only the rows that grads touch, after one step."""
    both = table.join(grads, keys)
    p, s = adagrad(F.col("vec"), F.col("grad"), F.col("state"), lr, SPARSE_EPS)
    return both.select(*keys, p.alias("vec"), s.alias("state"))


def _laid_over(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)


def batch_gradients(edges: DataFrame, model: Model, s: Settings, epoch: int, batch: int, n_nodes: int) -> DataFrame:
    """(kind, id, grad) of one batch, summed."""
    spark = edges.sparkSession
    parts = []
    for side, rel_kind in (("dst", "rel"), ("src", "inverse")) if s.inverse else (("dst", "rel"),):
        negatives = spark.range(s.negatives).select((draw(s.seed, F.lit(f"{epoch}:{batch}:{side}"), "id") % n_nodes).alias("node"))
        e = edges if side == "dst" else scoring.swapped(edges)
        parts.append(link_gradients(e, negatives, model.node_vectors, model.rel_vectors(rel_kind), s.decoder, s.loss, s.dim, s.margin, rel_kind))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("kind", "id").agg(V.sum_of_vectors("grad", s.dim).alias("grad"))


def batches_of(edges: DataFrame, size: int, seed: int, epoch: int) -> Iterator[DataFrame]:
    """The edges of an epoch, batch after batch, in an order by hash that is another one each epoch. The last batch may be smaller."""
    placed = written(with_batches(hash_positions(edges, f"{seed}:{epoch}", ["edge_id"]), size), "batches")
    last = placed.agg(F.max("batch_id")).first()[0]
    for b in range(0 if last is None else int(last) + 1):
        yield placed.filter(F.col("batch_id") == b)
    discard(placed)


def train_epoch(edges: DataFrame, model: Model, s: Settings, epoch: int, n_nodes: int) -> Model:
    """One pass. A batch writes the rows that it touches; tables are put together at the end, and the pieces deleted."""
    nodes, rels, pieces = model.nodes, model.rels, []
    for b, batch in enumerate(batches_of(edges, s.batch_edges, s.seed, epoch)):
        grads = written(batch_gradients(batch, Model(nodes, rels), s, epoch, b, n_nodes), "gradients")
        new_nodes = written(_stepped(nodes, grads.filter("kind = 'node'").select("id", "grad"), ["id"], s.lr), "nodes")
        new_rels = written(_stepped(rels, grads.filter("kind <> 'node'"), ["kind", "id"], s.lr), "rels")
        nodes, rels = _laid_over(nodes, new_nodes, ["id"]), _laid_over(rels, new_rels, ["kind", "id"])
        discard(grads)
        pieces += [new_nodes, new_rels]
    whole = Model(written(nodes, "nodes"), written(rels, "rels"))
    for p in pieces:
        discard(p)
    return whole


def train(edges: DataFrame, model: Model, s: Settings, epochs: int, path: str | None = None, valid: DataFrame | None = None) -> tuple[Model, list[dict]]:
    """The model after `epochs` in all, and after each that was run here the metrics of `valid`.

    With a path each epoch is kept as a version, and training goes on after the newest complete one: order and
    negatives depend on seed, epoch and batch only, so the result is that of an uninterrupted run, up to the order in
    which floats are added.
    """
    spark, start, history = edges.sparkSession, 0, []
    n_nodes = model.nodes.count()
    if path and (last := latest_state(spark, f"{path}/nodes")):
        start = last[0] + 1
        rels = spark.read.parquet(f"{path}/rels/epoch={last[0]}")
        model = Model(last[1].select("id", "vec", "state"), rels.select("kind", "id", "vec", "state"))
    for epoch in range(start, epochs):
        before, model = model, train_epoch(edges, model, s, epoch, n_nodes)
        if path:
            save_state(model.rels, f"{path}/rels", epoch)
            save_state(model.nodes, f"{path}/nodes", epoch)  # last: a version counts by it
        if epoch > start:
            discard(before.nodes)
            discard(before.rels)
        if valid is not None:
            r = scoring.both_side_ranks(valid, model.node_vectors, model.rel_vectors(), model.rel_vectors("inverse"), s.decoder, s.dim, edges.unionByName(valid, allowMissingColumns=True))
            history.append({"epoch": epoch, **r.agg(F.count(F.lit(1)).alias("n"), scoring.mrr().alias("mrr"), scoring.hits(10).alias("hits_10")).first().asDict()})
    return model, history


def train_classes(features: DataFrame, weights: np.ndarray, bias: np.ndarray, lr: float, epochs: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """A linear classifier of (id, vec, y_true) by full-batch gradient steps: weights (classes by dim), bias, and the mean loss before each.

    The model is as large as its classes and goes through the driver; rows stay where they are and send sums.
    """
    n_classes, dim = weights.shape
    losses = []
    for _ in range(epochs):

        def run(batches: Iterator[pa.RecordBatch], w=weights, b=bias) -> Iterator[pa.RecordBatch]:
            total, loss, rows = np.zeros((n_classes, dim + 1)), 0.0, 0
            for batch in batches:
                if batch.num_rows:
                    x, y = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, dim), np.asarray(batch.column(1))
                    z = x @ w.T + b
                    z -= z.max(1, keepdims=True)
                    p = np.exp(z)
                    p /= p.sum(1, keepdims=True)
                    loss -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
                    p[np.arange(len(y)), y] -= 1
                    total += np.concatenate([p.T @ x, p.sum(0)[:, None]], 1)
                    rows += len(y)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64())), pa.array([loss]), pa.array([rows], pa.int64())], names=["g", "loss", "n"])

        sums = features.select("vec", F.col("y_true").cast("int").alias("y_true")).filter("y_true >= 0").mapInArrow(run, "g array<double>, loss double, n bigint")
        k = n_classes * (dim + 1)
        r = sums.agg(V.sum_of_vectors("g", k).alias("g"), F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
        if not r.n:
            break
        g = np.array(r.g).reshape(n_classes, dim + 1) / r.n
        losses.append(r.loss / r.n)
        weights, bias = weights - lr * g[:, :dim], bias - lr * g[:, dim]
    return weights, bias, losses
