"""Gradients against differences, batches, resume, and classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import scoring, train


def _loss(decoder, loss, s, r, d, n):
    p, k = np.diag(scoring._np_scores(decoder, s, r, d)), scoring._np_scores(decoder, s, r, n)
    sp = lambda x: np.logaddexp(0, x)
    if loss in ("softmax_ce", "cross_entropy"):
        return (np.log(np.exp(p) + np.exp(k).sum(1)) - p).sum()
    return {
        "ranking": lambda: np.maximum(k - p[:, None] + 0.1, 0).sum(), "bce_sigmoid": lambda: sp(-p).sum() + sp(k).sum(), "bce_logits": lambda: sp(-p).sum() + sp(k).sum(),
        "mse": lambda: ((p - 1) ** 2).sum() + (k**2).sum(), "softplus": lambda: sp(-p).sum() + sp(k).sum(),
    }[loss]()


@pytest.mark.parametrize("decoder", ["distmult", "complex", "transe"])
@pytest.mark.parametrize("loss", train.LOSSES)
def test_gradients_are_differences(decoder, loss):
    rng = np.random.default_rng(1)
    x = [rng.standard_normal((m, 6)) for m in (4, 4, 4, 3)]
    got = train.slopes(decoder, loss, *x)
    for k in range(4):
        for at in np.ndindex(x[k].shape):
            step = 1e-6
            up, down = ([y.copy() for y in x] for _ in range(2))
            up[k][at] += step
            down[k][at] -= step
            assert got[k][at] == pytest.approx((_loss(decoder, loss, *up) - _loss(decoder, loss, *down)) / (2 * step), abs=2e-5)


def test_no_negatives_and_equal_ends():
    x = np.ones((2, 4))
    for decoder in ("distmult", "complex", "transe"):
        for loss in train.LOSSES:
            assert all(np.isfinite(g).all() for g in train.slopes(decoder, loss, x, 0 * x, x, np.zeros((0, 4))))


def _graph(spark, n=12, dim=4):
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(i, int(s), int(s) % 2, int((s + 1 + s % 2) % n)) for i, s in enumerate(rng.integers(0, n, 60))], "edge_id bigint, src bigint, rel bigint, dst bigint")
    rows = lambda k, m: [(*([k] if k else []), i, [float(x) for x in rng.standard_normal(dim) * 0.3], [0.0] * dim) for i in range(m)]
    nodes = spark.createDataFrame(rows(None, n), "id bigint, vec array<double>, state array<double>")
    rels = spark.createDataFrame(rows("rel", 2) + rows("inverse", 2), "kind string, id bigint, vec array<double>, state array<double>")
    return edges, train.Model(nodes, rels)


def _values(model):
    n = {r.id: r.vec for r in model.nodes.collect()}
    r = {(r.kind, r.id): r.vec for r in model.rels.collect()}
    return np.array([n[k] for k in sorted(n)]), np.array([r[k] for k in sorted(r)])


def test_resumed_equals_uninterrupted(spark, tmp_path):
    edges, model = _graph(spark)
    s = train.Settings(dim=4, batch_edges=40, negatives=5, lr=0.3)
    whole, history = train.train(edges, model, s, 2, valid=edges.limit(20))
    train.train(edges, model, s, 1, str(tmp_path))
    resumed, _ = train.train(edges, model, s, 2, str(tmp_path))
    for a, b, c in zip(_values(whole), _values(resumed), _values(model)):
        assert np.allclose(a, b, atol=1e-9) and not np.allclose(a, c, atol=1e-3)
    assert [h["epoch"] for h in history] == [0, 1] and history[0]["n"] == 40


def test_joined_vectors_give_the_same(spark, monkeypatch):
    edges, model = _graph(spark)
    edges = edges.unionByName(spark.createDataFrame([(90, 1, 0, 99), (91, None, 0, 1)], edges.schema))  # ends without a vector
    negs = spark.createDataFrame([(1,), (5,), (5,)], "node bigint")

    def grads():
        g = train.link_gradients(edges, negs, model.node_vectors, model.rel_vectors(), "complex", "softmax_ce", 4, slice_rows=1000)
        total = {}
        for r in g.collect():
            total[r.kind, r.id] = total.get((r.kind, r.id), 0) + np.array(r.grad)
        return total

    a = grads()
    monkeypatch.setattr(train, "BROADCAST_BYTES", 0)
    b = grads()
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_batches_hold_each_edge_once(spark):
    edges, _ = _graph(spark)
    seen = [[r.edge_id for r in b.collect()] for b in train.batches_of(edges, 25, 1, 0)]
    assert [len(x) for x in seen] == [25, 25, 10] and sorted(sum(seen, [])) == list(range(60))
    assert list(train.batches_of(edges.limit(0), 25, 1, 0)) == []
    other = [r.edge_id for b in train.batches_of(edges, 60, 1, 1) for r in b.collect()]
    assert sorted(other) == list(range(60))


def test_classes_are_learned(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(3) + 3 * np.eye(3)[i % 3]], i % 3 if i < 90 else -1) for i in range(100)]
    v = spark.createDataFrame(rows, "id bigint, vec array<double>, y_true int")
    w, b, losses = train.train_classes(v, np.zeros((3, 3)), np.zeros(3), 0.5, 4)
    assert losses[0] == pytest.approx(np.log(3)) and losses == sorted(losses, reverse=True)
    assert np.mean([(w @ np.array(x) + b).argmax() == y for _, x, y in rows[:90]]) > 0.9
    assert train.train_classes(v.filter("y_true < 0"), w, b, 0.5, 2)[2] == []
    g = train.class_gradients(v.filter("y_true >= 0").select("id", F.col("vec").alias("logits"), "y_true"), 3).collect()
    assert all(sum(r.grad) == pytest.approx(0) for r in g)
