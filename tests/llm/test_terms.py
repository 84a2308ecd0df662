"""Burst tries, cross-split pairs and similar vectors against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import cross_split, similar, term_counts
from tests.labels import EDGE_SCHEMA, normal
from tests.test_quality import _edge


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab_ß", max_size=7), st.integers(1, 5)), max_size=80), st.integers(1, 5))
def test_trie_counts(items, burst):
    trie, want = term_counts.BurstTrie(burst), Counter()
    for term, n in items:
        trie.add(term, n, 1)
        want[term] += n
    got = list(trie.items())
    assert {t: o for t, o, _ in got} == want and len(got) == len(want)
    assert sum(r for *_, r in got) == len(items)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab_ß", max_size=7), max_size=40), max_size=5), st.integers(1, 5))
def test_merged_tries(parts, burst):
    whole, want = term_counts.BurstTrie(burst), Counter()
    for terms in parts:
        trie = term_counts.BurstTrie(burst)
        for t in terms:
            trie.add(t, 2, 1)
            want[t] += 1
        whole.merge(trie)
    got = list(whole.items())
    assert {t: (o, r) for t, o, r in got} == {t: (2 * n, n) for t, n in want.items()} and len(got) == len(want)


@given(st.lists(st.text(alphabet="abc", max_size=6), max_size=60), st.integers(1, 20))
def test_routes(terms, n):
    routes = term_counts.Routes(terms, n)
    for t in [*terms, "", "zz", "abcabcabc"]:
        r = routes.of(t)
        assert t.startswith(r) and r in routes.known
        assert not any(t.startswith(k) and len(k) > len(r) for k in routes.known)


def test_heavy_prefixes_get_long_routes():
    terms = [f"part_{k:05d}" for k in range(5000)] + ["a", "b"]
    routes = term_counts.Routes(terms, 50)
    load = Counter(map(routes.of, terms))
    assert max(load.values()) <= 200 and len(load) >= 30


def _edges(spark, rows):
    return spark.createDataFrame(rows, EDGE_SCHEMA)


@pytest.mark.parametrize("flush", [400_000, 1])
def test_term_counts(spark, flush, monkeypatch):
    monkeypatch.setattr(term_counts, "ROUTED_ROWS", 64)
    rng = random.Random(4)
    names = [None, "", " -", "Hot", "hot ", "a_b", "A-b", "ｈot", "x" * 3000, "long" * 50]
    rows = [_edge(i, rng.choice(names), rng.choice(names[:6]), rng.choice(names)) for i in range(600)]
    occ, rec = Counter(), Counter()
    for r in rows:
        s, t, d = normal(r[1]), normal(r[2]), normal(r[3])
        occ.update(("node", x) for x in (s, d) if x)
        rec.update(("node", x) for x in {s, d} - {None})
        occ.update([("edge_type", t)] if t else [])
        rec.update([("edge_type", t)] if t else [])
    wide = _edges(spark, rows).select("*", F.lit(1).alias("term"), F.lit(1).alias("field"), F.lit("q").alias("SRC_column"))
    got = term_counts.term_counts(wide, burst=2, flush=flush).collect()
    assert {(r.field, r.term): r.occurrences for r in got} == occ and {(r.field, r.term): r.records for r in got} == rec
    assert term_counts.term_counts(wide.limit(0)).count() == 0


def test_marks(spark):
    c = spark.createDataFrame([("node", "a", 2), ("node", "b", 3), ("node", "c", 5), ("node", "d", 6)], "field string, term string, records bigint")
    assert {r.term: r.mark for r in term_counts.marked(c, 100).collect()} == {"a": "rare", "b": None, "c": None, "d": "common"}


def _near(a, b):
    """Whether a and b differ by at most one edit."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def _pairs(rows):
    out = set()
    e = [(r[0], normal(r[1]), normal(r[2]), normal(r[3]), r[5]) for r in rows]
    e = [x for x in e if None not in x]
    for i, s, t, d, sp in e:
        if sp != "train":
            continue
        for j, s2, t2, d2, sp2 in e:
            if sp2 in ("valid", "test") and t == t2 and ((s == s2 and _near(d, d2)) or (d == d2 and _near(s, s2)) or (s == d2 and _near(d, s2)) or (d == s2 and _near(s, d2))):
                out.add((min(i, j), max(i, j)))
    return out


def _edited(rng, x):
    k = rng.randrange(len(x) + 1)
    return rng.choice([x[:k] + rng.choice("ab1") + x[k:], x[:k] + x[k + 1 :], x[:k] + rng.choice("ab1") + x[k + 1 :]])


@pytest.mark.parametrize("seed", range(3))
def test_cross_split_pairs(spark, seed):
    rng = random.Random(seed)
    base = ["a", "ab", "hub_node_aaaaa", "hub_node_aaaab", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl", "ß_long_label_1", "x_y_0123456789"]
    labels = base + [y for x in base for y in {_edited(rng, x) for _ in range(4)} if y] + [None, "", " "]
    rows = [_edge(i, rng.choice(labels), rng.choice(["t", "T ", "u", None]), rng.choice(labels), split=rng.choice(["train", "valid", "test", "other", None])) for i in range(900)]
    rows += [_edge(2000 + i, "hub_node_aaaaa", "t", "copy_of_it", split="train") for i in range(40)] + [_edge(3000 + i, "copy-of-it", "t", "hub_node_aaaa", split="test", source=None) for i in range(5)]
    rows.append(_edge(None, "hub_node_aaaaa", "t", "copy_of_it", split="valid"))
    wide = _edges(spark, rows).select("*", F.lit(1).alias("key"), F.lit(1).alias("kind"), F.lit("q").alias("SPLIT"))
    found = cross_split.overlaps(wide)
    got = [(r.edge_id_a, r.edge_id_b) for r in found.select("edge_id_a", "edge_id_b").collect()]
    want = _pairs([r for r in rows if r[0] is not None])
    assert len(got) == len(set(got)) and set(got) == want
    counts = cross_split.overlap_counts(found).collect()
    assert sum(r.n_pairs for r in counts) == len(want)
    assert cross_split.overlaps(wide.limit(0)).count() == 0


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "node_id bigint, embedding array<float>, node_class int, updated_at timestamp_ntz")


def _best(rows, k=5, least=0.85):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v)]
    ok.sort(key=lambda x: x[0])
    ids, u = [i for i, _ in ok], np.array([v / np.linalg.norm(v) for _, v in ok])
    s = np.round(u @ u.T, 6)
    out = set()
    for a in range(len(ids)):
        order = [b for b in np.lexsort((ids, -s[a])) if b != a][:k]
        out |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in order if s[a, b] >= least}
    return out


def test_similar_hard_rows(spark):
    rng = np.random.default_rng(5)
    v = [rng.standard_normal(64) for _ in range(40)]
    rows = [(i, [float(x) for x in a], 1, None) for i, a in enumerate(v)]
    rows += [(100 + i, [float(x) for x in v[i % 4] + rng.standard_normal(64) * 0.15], None, None) for i in range(12)]
    rows += [(200 + i, [float(x) for x in v[5]], 1, None) for i in range(25)]  # copies beyond k + 1
    rows += [(300, None, 1, None), (301, [1.0] * 63, 1, None), (302, [0.0] * 64, 1, None), (303, [float("nan")] + [1.0] * 63, 1, None), (304, [float("inf")] + [1.0] * 63, 1, None), (305, [None] + [1.0] * 63, 1, None), (None, [1.0] * 64, 1, None)]
    rows += [(306, [3e38] * 64, 1, None), (307, [1e-40] * 64, 1, None)]
    wide = _vectors(spark, rows).select("*", F.lit(1).alias("cls"), F.lit(1).alias("EMBEDDING"))
    got = {(r.node_id_a, r.node_id_b) for r in similar.similar_pairs(wide).collect()}
    assert got == _best(rows)
    assert similar.similar_pairs(wide.limit(0)).count() == 0


def test_similar_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/node_embeddings.parquet").collect()]
    want = _best(rows)
    got = {(r.node_id_a, r.node_id_b) for r in similar.similar_pairs(_vectors(spark, rows)).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
