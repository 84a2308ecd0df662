"""Most similar vectors where many rows are near copies, against all pairs."""

import numpy as np
import pytest

from loomgraph.llm import similar
from tests.llm.test_terms import _best, _vectors


def _rows(ids, vectors):
    return [(int(i), [float(x) for x in v.astype(np.float32)], 1, None) for i, v in zip(ids, vectors)]


def test_third_are_near_copies(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    v = np.concatenate([centre + 0.115 * rng.standard_normal((1000, 64)), rng.standard_normal((2000, 64))])
    rows = _rows(rng.permutation(len(v)), v)
    want = _best(rows)
    got = {(r.node_id_a, r.node_id_b) for r in similar.similar_pairs(_vectors(spark, rows)).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_copies_behind_changed_ones(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(64)
    changed = base + 2e-4 * rng.standard_normal((20, 64))  # ties at 1.000000, other classes
    scaled = base * rng.uniform(0.1, 10, (60, 1))
    v = np.concatenate([changed, scaled, rng.standard_normal((40, 64))])
    rows = _rows(range(len(v)), v)
    got = {(r.node_id_a, r.node_id_b) for r in similar.similar_pairs(_vectors(spark, rows)).collect()}
    assert got == _best(rows)


@pytest.mark.parametrize("members", [300, 3000, 8000])
def test_recall_in_one_cluster(spark, members):
    """Queries are the ids divisible by 100, half of them in the cluster, against all rows."""
    rng = np.random.default_rng(members)
    centre = rng.standard_normal(64)
    v = np.concatenate([centre + 0.35 * rng.standard_normal((members, 64)), rng.standard_normal((10_000 - members, 64))]).astype(np.float32)
    ids = np.arange(len(v))
    rng.shuffle(ids[100:])
    ids[ids % 100 == 0] = np.sort(ids[ids % 100 == 0])  # the first of these are members
    found = {(r.node_id_a, r.node_id_b) for r in similar.similar_pairs(_vectors(spark, _rows(ids, v))).collect()}
    u = v / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = set()
    for at in np.flatnonzero(ids % 100 == 0):
        c = np.round(u @ u[at], 6)
        c[at] = -2
        want |= {tuple(sorted((int(ids[at]), int(ids[b])))) for b in np.lexsort((ids, -c))[:5] if c[b] >= 0.85}
    assert len(want) > members / 50 and len(found & want) >= 0.95 * len(want)


def test_parts_of_trees(spark, monkeypatch):
    """Trees cut into parts of few rows give the pairs that whole ones give."""
    rng = np.random.default_rng(11)
    v = np.repeat(rng.standard_normal((400, 64)), 3, axis=0) + 0.25 * rng.standard_normal((1200, 64))
    df = _vectors(spark, _rows(rng.permutation(len(v)), v))
    whole = {tuple(r) for r in similar.similar_pairs(df).collect()}
    monkeypatch.setattr(similar, "TASK_ROWS", 150)
    cut = {tuple(r) for r in similar.similar_pairs(df, wanted=256).collect()}
    assert len(whole) > 800 and len(whole & cut) >= 0.99 * len(whole)


def test_cuts_hold_whole_prefixes():
    counts = np.zeros((2, 16), np.int64)
    counts[0, :] = 100_000
    counts[1, 3] = 10**9
    cuts = similar._Cuts(counts)
    assert (cuts.depth[0] == 3).all() and len(np.unique(cuts.part[0])) == 8  # pairs of 100,000 fit
    assert cuts.depth[1, 3] == 4 and cuts.part[1, 2] != cuts.part[1, 3]
