"""Orderings, samplers, dictionaries and sources."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import gnn, ingest, optim, partition, sampling, scoring
from loomgraph.operators.order import hash_positions
from loomgraph.operators.sampling import Hop
from loomgraph.sources import delimited, sinks


@settings(deadline=None)
@given(st.integers(2, 14), st.integers(2, 6), st.integers(0, 5))
def test_beta_meets_every_pair(n, c, seed):
    states = partition.beta_states(n, min(c, n), seed)
    met = {frozenset(p) for s in states for p in combinations(s, 2)}
    assert len(met) == n * (n - 1) // 2
    assert all(len(set(a) ^ set(b)) == 2 for a, b in zip(states, states[1:]))
    assert all(len(set(s)) == min(c, n) for s in states)


@settings(deadline=None)
@given(st.integers(2, 6), st.integers(2, 4), st.integers(1, 3), st.integers(0, 3))
def test_two_levels_meet_every_pair(groups, slots, ratio, seed):
    slots = min(slots, groups)
    states = partition.two_level_states(groups * ratio, slots * ratio, ratio, 0, seed)
    assert {p for s in states for p in combinations(sorted(s), 2)} == set(combinations(range(groups * ratio), 2))
    cached = partition.two_level_states(groups * ratio + 2 * ratio, (slots + 1) * ratio, ratio, 1, seed)
    assert {frozenset(p) for s in cached for p in combinations(s, 2)} == {frozenset(p) for p in combinations(range((groups + 2) * ratio), 2)}


@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 3))
def test_dispersed_and_sequential(n, c, seed):
    c = min(n, c)
    assert {p for s in partition.dispersed_states(n, c, seed) for p in s} == set(range(n))
    (s,) = partition.sequential_state(n, c, list(range(c // 2)), seed)
    assert set(range(c // 2)) <= set(s) and len(set(s)) == c


def test_assignment_covers_each_bucket_once(spark):
    states = partition.states_table(spark, partition.beta_states(6, 3, 2))
    for a in (partition.greedy_assignment(states), partition.random_assignment(states, 3)):
        rows = a.collect()
        assert len(rows) == 36 == len({(r.src_part, r.dst_part) for r in rows})
        held = {}
        for r in states.collect():
            held.setdefault(r.state_id, set()).add(r.part)
        assert all({r.src_part, r.dst_part} <= held[r.state_id] for r in rows)


def test_split_sizes_and_tail(spark):
    e = spark.range(103).select(F.col("id").alias("edge_id"))
    n = lambda df: Counter(r.split for r in df.collect())
    assert n(ingest.split_edges(e)) == {"train": 92, "valid": 5, "test": 6}
    assert n(ingest.split_edges(e, (0.5, 0.2), ("train", "test"))) == {"train": 51, "test": 20}
    assert n(ingest.split_edges(e.limit(0))) == {}


def test_positions_are_dense(spark):
    got = {r.id: r.pos for r in hash_positions(spark.range(5000), 1, ["id"]).collect()}
    assert sorted(got.values()) == list(range(5000))
    assert got == {r.id: r.pos for r in hash_positions(spark.range(5000), 1, ["id"], digits=1).collect()}


def test_unknown_label_raises(spark):
    e = spark.createDataFrame([("a", "r", "zz")], "src string, rel string, dst string")
    d = spark.createDataFrame([("a", 0)], "label string, id bigint")
    r = spark.createDataFrame([("r", 0)], "label string, id bigint")
    with pytest.raises(Exception, match="dst holds a label"):
        ingest.apply_mapping(e, d, r).collect()
    assert ingest.apply_mapping(e, d, r, strict=False).first().dst is None


EDGES = [(0, 0, 2), (0, 1, 4), (1, 1, 3), (1, 0, 5), (4, 0, 2), (5, 1, 2)]


@pytest.fixture()
def six(spark):
    return spark.createDataFrame([(i, *e) for i, e in enumerate(EDGES)], "edge_id bigint, src bigint, rel bigint, dst bigint")


def test_neighbours_and_hops(spark, six):
    roots = spark.createDataFrame([(2,)], "node bigint")
    nodes, links = sampling.layered(roots, six, [Hop(), Hop()])
    assert {(r.hop, r.node) for r in nodes.collect()} == {(0, 2), (1, 0), (1, 4), (1, 5), (2, 1)}
    assert Counter(r.hop for r in links.collect()) == {1: 3, 2: 6}
    few = sampling.sampled(sampling.neighbours(roots, six, True), Hop("uniform", 2), 1)
    assert few.count() == 2
    drawn = sampling.sampled(sampling.neighbours(roots, six, True), Hop("replaced", 2), 1).collect()
    assert len(drawn) == 2 and {r.nbr for r in drawn} <= {0, 4, 5}
    assert sampling.neighbours(roots, six.limit(0), True).count() == 0


@pytest.mark.parametrize("chunks,n,fraction", [(1, 5, 0.0), (3, 5, 0.0), (1, 5, 0.5), (3, 5, 0.5), (1, 5, 1.0), (3, 5, 1.0)])
def test_negative_shapes(spark, six, chunks, n, fraction):
    placed = hash_positions(six, 1, ["edge_id"])
    got = sampling.mixed_negatives(spark, placed, 6, 6, chunks, n, fraction).collect()
    assert Counter(r.chunk_id for r in got) == {c: n for c in range(chunks)}
    assert all(0 <= r.node < 6 for r in got)
    assert sum(r.edge_pos is not None for r in got) == chunks * int(n * fraction)


def test_filters_find_edges(spark, six):
    known = six.unionByName(spark.createDataFrame([(9, 0, 1, 3)], six.schema))
    got = sorted(tuple(r) for r in sampling.known_ends(six, known).collect())
    assert got == sorted(x for x in {*EDGES, (0, 1, 3)} if any(x[:2] == y[:2] for y in EDGES))
    assert sampling.drop_known(known, six).count() == 1


VECS = [[1.5, 2.5], [2.5, 3.5], [4.25, 1.0], [-1.0, 0.5]]


def test_ranks_in_blocks_equal_broadcast(spark, monkeypatch):
    nodes = spark.createDataFrame(list(enumerate(VECS)), "id bigint, vec array<double>")
    rels = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.5, -1.0])], "rel bigint, vec array<double>")
    e = spark.createDataFrame([(i, i % 4, i % 2, (i * 3 + 1) % 4) for i in range(8)], "edge_id bigint, src bigint, rel bigint, dst bigint")
    for dec in ("distmult", "complex", "transe", "cosine"):
        a = sorted(map(tuple, scoring.all_node_ranks(e, nodes, rels, dec, 2, e).collect()))
        with monkeypatch.context() as m:
            m.setattr(scoring, "BROADCAST_BYTES", 0)
            m.setattr(scoring, "BLOCK_NODES", 2)
            assert sorted(map(tuple, scoring.all_node_ranks(e, nodes, rels, dec, 2, e).collect())) == a
        assert min(r for _, r in a) >= 1
        assert min(r.rank for r in scoring.all_node_ranks(e, nodes, rels, dec, 2).collect()) >= 2


def test_known_counted_for_a_hub(spark):
    rng = np.random.default_rng(3)
    score = lambda: float(rng.integers(-20, 20)) / 7
    pos = [(i, 0 if i % 3 else i % 5, i % 2, score()) for i in range(300)]
    known = [(0 if i % 4 else i % 5, i % 2, score()) for i in range(500)]
    got = {r.edge_id: r.n_known for r in scoring.known_at_least(spark.createDataFrame(pos, "edge_id bigint, src bigint, rel bigint, score double"), spark.createDataFrame(known, "src bigint, rel bigint, score double")).collect()}
    assert got == {i: sum(k == (s, r) and x >= p for *k, x in [((a, b), c) for a, b, c in known] for k in [k[0]]) for i, s, r, p in pos}


def test_both_sides(spark):
    nodes = spark.createDataFrame(list(enumerate(VECS)), "id bigint, vec array<double>")
    rels, inverse = (spark.createDataFrame(x, "rel bigint, vec array<double>") for x in ([(0, [1.0, 1.0])], [(0, [0.5, -1.0])]))
    e = spark.createDataFrame([(i, i % 4, 0, (i * 3 + 1) % 4) for i in range(4)], "edge_id bigint, src bigint, rel bigint, dst bigint")
    got = {(r.edge_id, r.side): r.rank for r in scoring.both_side_ranks(e, nodes, rels, inverse, "distmult", 2).collect()}
    v, r = np.array(VECS), {"dst": np.array([1.0, 1.0]), "src": np.array([0.5, -1.0])}
    for i in range(4):
        for side, (a, b) in {"dst": (i % 4, (i * 3 + 1) % 4), "src": ((i * 3 + 1) % 4, i % 4)}.items():
            scores = v @ (v[a] * r[side])
            assert got[i, side] == 1 + (scores.round(9) >= scores[b].round(9)).sum()


def test_sum_is_n_times_mean_and_margin_counts(spark):
    negs = [500.0, 0.5, -3.0, 7.5, -500.0]
    scored = spark.createDataFrame([(0, 500.0, negs), (1, 0.1, negs), (2, -500.0, negs)], "edge_id bigint, score double, negs array<double>")
    for kind, n in (("softmax_ce", 3), ("cross_entropy", 3), ("ranking", 15), ("bce_sigmoid", 18), ("bce_logits", 18), ("mse", 18), ("softplus", 18)):
        r = scoring.link_loss(kind, scored).first()
        assert np.isfinite(r.loss_sum) and r.loss_sum == pytest.approx(n * r.loss_mean)
        assert scoring.link_loss(kind, scored.limit(0)).first().loss_sum is None
        alone = scored.limit(1).withColumn("negs", F.array().cast("array<double>"))
        assert scoring.link_loss(kind, alone).first().loss_sum is not None
    assert scoring.link_loss("ranking", scored, 5.0).first().loss_sum > scoring.link_loss("ranking", scored, 0.1).first().loss_sum
    with pytest.raises(ValueError):
        scoring.pointwise_loss("none", F.lit(1), F.lit(1))
    for m in ("mrr", "MeanReciprocalRank", "Hits@10", "hitsk5", "MR", "acc"):
        scoring.metric(m)
    with pytest.raises(ValueError):
        scoring.metric("auc")


def test_adagrad_fixture(spark):
    nodes = spark.createDataFrame([(0, [2.0, 4.0], [0.0, 0.0]), (1, [1.0, 1.0], [0.0, 0.0])], "id bigint, vec array<double>, state array<double>")
    grads = spark.createDataFrame([(0, [0.25, -0.5]), (0, [0.25, -0.5])], "id bigint, grad array<double>")
    got = {r.id: r for r in optim.sparse_adagrad(nodes, grads, 1.0, 2).collect()}
    assert got[0].vec == pytest.approx([1.0, 5.0]) and got[0].state == pytest.approx([0.25, 1.0])
    assert got[1].vec == [1.0, 1.0]


def test_isolated_node_keeps_own_vector(spark):
    nodes = spark.createDataFrame(list(enumerate(VECS)), "id bigint, vec array<double>")
    e = spark.createDataFrame([(0, 0, 1)], "src bigint, rel int, dst bigint")
    w = np.eye(2)
    got = {r.id: r.vec for r in gnn.sage_mean(nodes, gnn.neighbour_pairs(e), w, w).collect()}
    assert got[3] == pytest.approx(VECS[3]) and got[0] == pytest.approx([4.0, 6.0])
    assert sum(r.alpha for r in gnn.attention_softmax(spark.createDataFrame([(0, 1.0), (0, 800.0), (1, -800.0)], "center int, logit double")).collect()) == pytest.approx(2.0)


def test_query_file():
    text = "lives_in\nSELECT customers.customername, customers.country FROM customers\nordered\nSELECT orders.item, customers.country FROM customers, orders"
    pairs = delimited.query_pairs(text)
    assert [p[0] for p in pairs] == ["lives_in", "ordered"]
    assert delimited.query_entities(pairs[1][1]) == (("orders", "item"), ("customers", "country"))
    for bad in ("a", "a\n\nb\nc", ""):
        with pytest.raises(ValueError):
            delimited.query_pairs(bad)
    for bad in ("SELECT a.b AS c, d.e FROM a", "SELECT b, c FROM a", "UPDATE a"):
        with pytest.raises(ValueError):
            delimited.query_entities(bad)


def test_golden_edges(spark):
    spark.createDataFrame([(1, "Daiyu", "China"), (2, " 'Rafael' ", "Italy."), (3, None, "Italy"), (4, "not reported", "China")], "id int, customername string, country string").createOrReplaceTempView("customers")
    spark.createDataFrame([(1, 1, "Book"), (2, 2, "book"), (3, 1, "BOOK")], "id int, customerid int, item string").createOrReplaceTempView("orders2")
    q = [("lives_in", "SELECT customers.customername, customers.country FROM customers"), ("ordered", "SELECT orders2.item, customers.country FROM customers, orders2 WHERE orders2.customerid = customers.id")]
    got = {"\t".join(r) for r in ingest.sql_to_edges(spark, q, [delimited.query_entities(s) for _, s in q]).collect()}
    assert got == {
        "customers_customername_daiyu\tlives_in\tcustomers_country_china", "customers_customername_rafael\tlives_in\tcustomers_country_italy",
        "orders2_item_book\tordered\tcustomers_country_china", "orders2_item_book\tordered\tcustomers_country_italy",
    }


@pytest.mark.parametrize("header", [0, 1, 3])
def test_delimited_headers(spark, tmp_path, header):
    for k in range(2):
        (tmp_path / f"f{k}.csv").write_text("".join(f"head{i},h,h,h\n" for i in range(header)) + "".join(f"s{k}_{i},r,d{i},{i}\n" for i in range(50)))
    got = delimited.read_delimited(spark, [str(tmp_path / f"f{k}.csv") for k in range(2)], {"src_column": 0, "edge_type_column": 1, "dst_column": 2, "edge_weight_column": 3}, ",", header)
    rows = got.collect()
    assert len(rows) == 100 and {r.src for r in rows} == {f"s{k}_{i}" for k in range(2) for i in range(50)} and sum(r.weight for r in rows) == 2 * 1225
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(tmp_path), {"src_column": 0})
    split = delimited.custom_dataset(spark, [str(tmp_path / "f0.csv"), str(tmp_path / "f1.csv")], {"src_column": 0, "dst_column": 2}, ",", header)
    assert Counter(r.split for r in split.collect()) == {"train": 50, "test": 50}
    assert Counter(r.split for r in delimited.custom_dataset(spark, [str(tmp_path / "f0.csv")], {"src_column": 0, "dst_column": 2}, ",", header).collect()) == {"train": 45, "valid": 2, "test": 3}


def test_binary_and_arrays(spark, tmp_path):
    a = np.arange(300, dtype=np.int32).reshape(-1, 3)
    a.tofile(tmp_path / "e.bin")
    got = delimited.read_binary(spark, str(tmp_path / "e.bin"), ("src", "rel", "dst")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, a.tolist()))
    assert delimited.from_array(spark, a[:, :2], np.arange(100)).agg(F.sum("weight")).first()[0] == 4950


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    got = delimited.read_database(spark, url, 'SELECT "id" FROM t', driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert sorted(r[0] for r in got.collect()) == [1, 2]


def test_export_refuses_to_overwrite(spark, tmp_path):
    v = spark.createDataFrame([(0, [1.0, 2.0])], "id bigint, vec array<double>")
    m = spark.createDataFrame([("x", 0)], "label string, id bigint")
    p = str(tmp_path / "out")
    sinks.export_embeddings(v, m, p)
    with pytest.raises(Exception, match="already exists"):
        sinks.export_embeddings(v, m, p)
    sinks.export_embeddings(v, m, p, overwrite=True)
    with pytest.raises(ValueError):
        sinks.export_embeddings(v, m, p, "npy", True)
    assert sinks.latest_state(spark, str(tmp_path / "none")) is None


def test_facade(spark):
    e = spark.createDataFrame([(i, f"a{i % 7}", "r", f"b{i % 11}") for i in range(77)], "edge_id bigint, src string, rel string, dst string")
    g = Graph.prepare(e, train_first=True)
    assert g.stats().first().asDict() == {"num_edges": 77, "num_nodes": 18, "num_relations": 1, "num_train": 69, "num_valid": 3, "num_test": 5}
    vec = optim.initial_vectors(g.nodes, 4, 1.0)
    rel = g.rels.select(F.col("id").alias("rel"), F.array_repeat(F.lit(1.0), 4).alias("vec"))
    out = g.predict_links(vec, rel, "distmult", 4)
    assert out.count() == 5 and out.filter("rank < 1").count() == 0
    assert Graph.report(out, ["MRR", "HITS@3"]).first().n == 5
    assert g.degrees().agg(F.sum("degree")).first()[0] == 154
    assert optim.fans((3, 4)) == (3, 4) and optim.fans((5,)) == (5, 5) and optim.fans(()) == (1, 1)


def test_orphan_stream(spark, tmp_path):
    from loomgraph.streaming import updates

    schema = "kind string, parent string, label string, delta bigint"
    p = str(tmp_path / "s")
    batches = ([("reference", "p", "a", None), ("reference", "p", "a", None), ("parent", "p", "b", 1)], [("parent", "p", "a", 1), ("reference", "p", "b", None)], [("parent", "p", "b", -1)])
    want = [{("a", 0, 2), ("b", 1, 0)}, {("a", 1, 2), ("b", 1, 1)}, {("a", 1, 2), ("b", 0, 1)}]
    for rows, state in zip(batches, want):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{p}/in")
        q = updates.orphans_of_stream(spark.readStream.schema(schema).parquet(f"{p}/in"), p)
        q.processAllAvailable()
        q.stop()
        assert {(r.label, r.live, r.n_refs) for r in updates.current(spark, p).collect()} == state


def test_relations_in_blocks_equal_broadcast(spark, monkeypatch):
    from loomgraph import session

    nodes = spark.createDataFrame(list(enumerate(VECS)), "id bigint, vec array<double>")
    rels = spark.createDataFrame([(k, [float(k), 1.0 - k]) for k in range(7)], "rel bigint, vec array<double>")
    e = spark.createDataFrame([(i, i % 4, i % 2, (i * 3 + 1) % 4, i % 2) for i in range(8)], "edge_id bigint, src bigint, rel bigint, dst bigint, chunk_id bigint")
    negs = sampling.uniform_negatives(spark, 2, 3, 4, 5)

    def both():
        rows = {dec: sorted((r.edge_id, round(r.score, 9), [round(x, 9) for x in r.negs]) for r in scoring.chunk_rows(e, negs, nodes, rels, dec, 2).collect()) for dec in ("distmult", "complex", "transe", "cosine")}
        return sorted(map(tuple, scoring.relation_scores(e, nodes, rels, "distmult").collect())), sorted(map(tuple, scoring.chunk_scores(e, negs, nodes, rels, "complex").collect())), rows

    a = both()
    assert len(a[0]) == 56 and len(a[1]) == 24
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(scoring, "BLOCK_RELS", 3)
    assert both() == a


def test_spread_only_small_tables(spark):
    from loomgraph.session import spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(0, 10, 1, cores + 3)).rdd.getNumPartitions() == cores + 3
