"""Buckets, orderings, neighbours and negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.hashing import digest_sql, draw_sql, unit_sql
from loomgraph.operators import ingest, partition, sampling
from loomgraph.operators.order import hash_positions, with_batches, with_chunks
from loomgraph.operators.sampling import Hop
from loomgraph.plans.views import INT, TYPED, VECTOR_EDGES, int_edges, typed_edges, vector_edges
from loomgraph.session import table

PARTS = 8
STATES = partition.beta_states(PARTS, 3, 1)


def _max_part(spark, d):
    return table(spark, d, "part").agg(F.max("p_partkey")).first()[0] + 1


def _parted(spark, d):
    return partition.with_parts(int_edges(spark, d), _max_part(spark, d), PARTS)


def node_parts(spark, d):
    return _parted(spark, d).select("edge_id", "src_part", "dst_part")


def edge_buckets(spark, d):
    return partition.bucket_counts(_parted(spark, d))


def bucket_grid_with_zeros(spark, d):
    return partition.bucket_grid(spark, _parted(spark, d), PARTS).select("src_part", "dst_part", "n_edges")


def bucket_offsets(spark, d):
    return partition.bucket_grid(spark, _parted(spark, d), PARTS)


def sort_buckets(spark, d):
    return partition.sorted_buckets(_parted(spark, d), 4).select("src_part", "dst_part", "src", "dst", "edge_id")


def induced_subgraph(spark, d):
    return partition.induced_subgraph(_parted(spark, d), (0, 2, 5)).select("edge_id", "src", "dst")


def greedy_bucket_assignment(spark, d):
    return partition.greedy_assignment(partition.states_table(spark, STATES))


def random_bucket_assignment(spark, d):
    return partition.random_assignment(partition.states_table(spark, STATES), 4)


def active_edges(spark, d):
    """Edges by the buffer state that processes them."""
    where = partition.greedy_assignment(partition.states_table(spark, STATES))
    return _parted(spark, d).join(where, ["src_part", "dst_part"]).groupBy("state_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("edge_id") % 1000003).alias("sum_edge_id"))


def buffer_swap_diff(spark, d):
    return partition.swaps(partition.states_table(spark, STATES))


def buffer_map(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return partition.buffer_map(nodes, partition.states_table(spark, STATES), _max_part(spark, d), PARTS)


def _graph(spark, d):
    return typed_edges(spark, d).select("edge_id", "src", "rel", "dst")


def _customers(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"))


def _parts(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"))


def nbrs_all_out(spark, d):
    return sampling.neighbours(_customers(spark, d), _graph(spark, d), False).drop("incoming")


def nbrs_all_in(spark, d):
    return sampling.neighbours(_parts(spark, d), _graph(spark, d), True).drop("incoming")


def nbrs_uniform_k(spark, d):
    return sampling.sampled(sampling.neighbours(_parts(spark, d), _graph(spark, d), True), Hop("uniform", 5), 21).drop("incoming")


def nbrs_with_replacement(spark, d):
    return sampling.sampled(sampling.neighbours(_parts(spark, d), _graph(spark, d), True), Hop("replaced", 20), 22).drop("incoming")


def nbrs_dropout(spark, d):
    return sampling.sampled(sampling.neighbours(_parts(spark, d), _graph(spark, d), True), Hop("dropout", rate=0.3), 23).drop("incoming")


def _khop(spark, d):
    return sampling.layered(_customers(spark, d), _graph(spark, d), [Hop("all"), Hop("uniform", 3)], seed=30)


def khop_frontier(spark, d):
    return _khop(spark, d)[0]


def khop_edges(spark, d):
    return _khop(spark, d)[1].withColumn("incoming", F.col("incoming").cast("int"))


def next_layer_edges(spark, d):
    return sampling.next_layer(_khop(spark, d)[1], 2, 2).groupBy("center").agg(F.count(F.lit(1)).alias("n_neighbours"))


def combined_neighbours(spark, d):
    e = _graph(spark, d)
    both = sampling.neighbours(_customers(spark, d), e, False).unionByName(sampling.neighbours(_parts(spark, d), e, True))
    return both.groupBy("center").agg(F.count(F.lit(1)).alias("n_neighbours"), F.countDistinct("nbr").alias("n_distinct"))


def _met(spark, states):
    """(src_part, dst_part): pairs of partitions that some state holds together."""
    return partition.greedy_assignment(partition.states_table(spark, states)).select("src_part", "dst_part")


def order_beta(spark, d):
    return _met(spark, partition.beta_states(PARTS, 3, 5))


def order_two_level(spark, d):
    return _met(spark, partition.two_level_states(PARTS, 4, 2, 0, 6))


def order_by_name(spark, d):
    return _met(spark, partition.buffer_states("beta", PARTS, 4, seed=7))


def order_dispersed(spark, d):
    """(part): partitions that have been resident."""
    return partition.states_table(spark, partition.dispersed_states(PARTS, 3, 8)).select("part").distinct()


def order_sequential(spark, d):
    """(part, train): whether a train partition is resident, of the one state there is."""
    state = partition.states_table(spark, partition.sequential_state(PARTS, 4, (1, 6), 9))
    return state.filter(F.col("part").isin(1, 6)).select("part", "state_id")


def local_ids(spark, d):
    placed = with_batches(hash_positions(int_edges(spark, d), 14, ["edge_id"]), 1000)
    return sampling.local_ids(placed, ["src", "dst"])


def local_edges(spark, d):
    """Edges of each batch in ids local to the batch."""
    placed = with_batches(hash_positions(int_edges(spark, d), 14, ["edge_id"]), 1000)
    ids = sampling.local_ids(placed, ["src", "dst"])
    side = lambda c: ids.select("batch_id", F.col("node").alias(c), F.col("local_id").alias(f"local_{c}"))
    return placed.join(side("src"), ["batch_id", "src"]).join(side("dst"), ["batch_id", "dst"]).select("edge_id", "batch_id", "local_src", "local_dst")


CHUNKS, PER_CHUNK = 10, 16


def _placed(spark, d):
    e = vector_edges(spark, d)
    e = e.withColumn("edge_id", (F.col("src") * 4 + F.col("rel")) * 1_000_000 + F.col("dst"))
    n = e.count()
    return with_chunks(hash_positions(e, 40, ["edge_id"]), CHUNKS, n), n, table(spark, d, "embeddings").count()


def negatives_uniform(spark, d):
    return sampling.uniform_negatives(spark, CHUNKS, PER_CHUNK, table(spark, d, "embeddings").count(), 41)


def negatives_degree(spark, d):
    placed, n, _ = _placed(spark, d)
    return sampling.degree_negatives(spark, placed, n, CHUNKS, PER_CHUNK, "dst", 42)


def negatives_mixed(spark, d):
    placed, n, nodes = _placed(spark, d)
    return sampling.mixed_negatives(spark, placed, n, nodes, CHUNKS, PER_CHUNK, 0.5, "dst", 42)


def local_filter(spark, d):
    placed, _, nodes = _placed(spark, d)
    return sampling.local_matches(placed, sampling.uniform_negatives(spark, CHUNKS, PER_CHUNK, nodes, 41), placed)


def degree_filter(spark, d):
    placed, n, nodes = _placed(spark, d)
    negatives = sampling.mixed_negatives(spark, placed, n, nodes, CHUNKS, PER_CHUNK, 0.5, "dst", 42)
    return sampling.own_chunk_matches(placed, negatives, -(-n // CHUNKS))


def known_edge_filter(spark, d):
    e = _graph(spark, d)
    return sampling.known_ends(e, e).groupBy("src", "rel").agg(F.count(F.lit(1)).alias("n_known"))


def negatives_all_filtered(spark, d):
    e = _graph(spark, d)
    return sampling.filtered_negative_counts(e, e, table(spark, d, "part").count())


def known_edge_antijoin(spark, d):
    """Edges with the dst of another relation's edge that aren't edges themselves."""
    e = _graph(spark, d)
    shifted = e.withColumn("rel", F.when(F.col("rel") == "A", "N").when(F.col("rel") == "N", "R").otherwise("A"))
    return sampling.drop_known(shifted, e)


def all_edges(spark, d):
    """Bag union of all splits and further known edges."""
    s = ingest.split_edges(_graph(spark, d), seed=11)
    union = s.filter("split = 'train'").unionByName(s.filter("split = 'valid'")).unionByName(s.filter("split = 'test'")).drop("split").unionByName(_graph(spark, d))
    return union.groupBy("src").agg(F.count(F.lit(1)).alias("n_edges"))


QUERIES = {
    f.__name__: f
    for f in (
        node_parts, edge_buckets, bucket_grid_with_zeros, bucket_offsets, sort_buckets, induced_subgraph, greedy_bucket_assignment, random_bucket_assignment, active_edges, buffer_swap_diff, buffer_map,
        nbrs_all_out, nbrs_all_in, nbrs_uniform_k, nbrs_with_replacement, nbrs_dropout, khop_frontier, khop_edges, next_layer_edges, combined_neighbours, local_ids,
        local_edges, order_beta, order_two_level, order_by_name, order_dispersed, order_sequential,
        negatives_uniform, negatives_degree, negatives_mixed, local_filter, degree_filter, known_edge_filter, negatives_all_filtered, known_edge_antijoin, all_edges,
    )
}

_SIZE = f"(SELECT ceil((max(p_partkey) + 1) / {PARTS})::BIGINT FROM part)"
_PARTED = f"{INT}, q AS (SELECT *, (src // {_SIZE})::INTEGER AS src_part, (dst // {_SIZE})::INTEGER AS dst_part FROM i)"
_GRID = f"gr AS (SELECT (k // {PARTS})::INTEGER AS src_part, (k % {PARTS})::INTEGER AS dst_part FROM range({PARTS * PARTS}) r(k)), full_ AS (SELECT gr.src_part, gr.dst_part, count(edge_id) AS n_edges FROM gr LEFT JOIN q ON q.src_part = gr.src_part AND q.dst_part = gr.dst_part GROUP BY 1, 2)"
_STATES = f"st(state_id, slot, part) AS (VALUES {', '.join(f'({s}, {k}, {p})' for s, x in enumerate(STATES) for k, p in enumerate(x))})"
_HELD = "held AS (SELECT a.part AS src_part, b.part AS dst_part, a.state_id FROM st a JOIN st b ON a.state_id = b.state_id)"
_GREEDY = "gd AS (SELECT src_part, dst_part, min(state_id) AS state_id FROM held GROUP BY 1, 2)"
_CUST = "f AS (SELECT 'c' || c_custkey AS node FROM customer)"
_PART = "f AS (SELECT 'p' || p_partkey AS node FROM part)"
_IN = "nb AS (SELECT dst AS center, src AS nbr, rel, edge_id FROM e JOIN f ON dst = node)"
_OUT = "nb AS (SELECT src AS center, dst AS nbr, rel, edge_id FROM e JOIN f ON src = node)"
_HOPS = f"""roots AS (SELECT DISTINCT 'c' || c_custkey AS node FROM customer),
h1 AS (SELECT node AS center, src AS nbr, rel, edge_id, 1 AS incoming FROM e JOIN roots ON dst = node UNION ALL SELECT node, dst, rel, edge_id, 0 FROM e JOIN roots ON src = node),
f1 AS (SELECT nbr AS node FROM h1 EXCEPT SELECT node FROM roots),
a2 AS (SELECT node AS center, src AS nbr, rel, edge_id, 1 AS incoming FROM e JOIN f1 ON dst = node UNION ALL SELECT node, dst, rel, edge_id, 0 FROM e JOIN f1 ON src = node),
n2 AS (SELECT *, row_number() OVER (PARTITION BY center, incoming ORDER BY CASE incoming WHEN 1 THEN {digest_sql(51, "center", "edge_id")} ELSE {digest_sql(50, "center", "edge_id")} END, edge_id) AS rn FROM a2),
h2 AS (SELECT center, nbr, rel, edge_id, incoming FROM n2 WHERE rn <= 3),
f2 AS (SELECT nbr AS node FROM h2 EXCEPT SELECT node FROM roots EXCEPT SELECT node FROM f1)"""
_BATCHED = f"p AS (SELECT *, (row_number() OVER (ORDER BY {digest_sql(14, 'edge_id')}, edge_id) - 1) // 1000 AS batch_id FROM i)"
_LOCAL = "u AS (SELECT batch_id, src AS node FROM p UNION SELECT batch_id, dst FROM p), li AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY node) - 1 AS local_id FROM u)"
_NODES = "(SELECT count(*) FROM embeddings)"
_CHUNKED = f"""{VECTOR_EDGES}, ge AS (SELECT *, (src * 4 + rel) * 1000000 + dst AS edge_id FROM g), gp AS (SELECT *, row_number() OVER (ORDER BY {digest_sql(40, "edge_id")}, edge_id) - 1 AS pos, count(*) OVER () AS total FROM ge),
gc AS (SELECT *, pos // ceil(total / {CHUNKS})::BIGINT AS chunk_id FROM gp)"""


def _negatives(name: str, n: int, shift: int = 0) -> str:
    return f"{name} AS (SELECT k // {n} AS chunk_id, k % {n} AS neg_id, k % {n} + {shift} AS shifted FROM range({CHUNKS * n}) r(k))"


_UNIFORM = f"{_negatives('uk', PER_CHUNK)}, un AS (SELECT chunk_id, neg_id, {draw_sql(41, 'chunk_id', 'neg_id')} % {_NODES} AS node FROM uk)"
_HALF = PER_CHUNK // 2
_MIXED = f"""{_negatives("dk", _HALF)}, {_negatives("ek", _HALF, _HALF)}, dn AS (SELECT chunk_id, neg_id, {draw_sql(42, "chunk_id", "neg_id")} % (SELECT count(*) FROM ge) AS edge_pos FROM dk),
mx AS (SELECT dn.chunk_id, neg_id, dst AS node, edge_pos FROM dn JOIN gp ON pos = edge_pos UNION ALL SELECT chunk_id, shifted, {draw_sql(43, "chunk_id", "neg_id")} % {_NODES}, NULL FROM ek)"""

SQL = {
    "node_parts": f"WITH {_PARTED} SELECT edge_id, src_part, dst_part FROM q",
    "edge_buckets": f"WITH {_PARTED} SELECT src_part, dst_part, count(*) AS n_edges FROM q GROUP BY 1, 2",
    "bucket_grid_with_zeros": f"WITH {_PARTED}, {_GRID} SELECT * FROM full_",
    "bucket_offsets": f"WITH {_PARTED}, {_GRID} SELECT *, coalesce(sum(n_edges) OVER (ORDER BY src_part, dst_part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_before FROM full_",
    "sort_buckets": f"WITH {_PARTED} SELECT src_part, dst_part, src, dst, edge_id FROM q ORDER BY 1, 2, 3, 4",
    "induced_subgraph": f"WITH {_PARTED} SELECT edge_id, src, dst FROM q WHERE src_part IN (0, 2, 5) AND dst_part IN (0, 2, 5)",
    "greedy_bucket_assignment": f"WITH {_STATES}, {_HELD}, {_GREEDY} SELECT * FROM gd",
    "random_bucket_assignment": f"WITH {_STATES}, {_HELD}, r AS (SELECT *, row_number() OVER (PARTITION BY src_part, dst_part ORDER BY {digest_sql(4, 'src_part', 'dst_part', 'state_id')}, state_id) AS rn FROM held) SELECT src_part, dst_part, state_id FROM r WHERE rn = 1",
    "active_edges": f"WITH {_PARTED}, {_STATES}, {_HELD}, {_GREEDY} SELECT state_id, count(*) AS n_edges, sum(edge_id % 1000003)::BIGINT AS sum_edge_id FROM q JOIN gd ON q.src_part = gd.src_part AND q.dst_part = gd.dst_part GROUP BY state_id",
    "buffer_swap_diff": f"WITH {_STATES}, a AS (SELECT state_id, part FROM st WHERE state_id > 0 EXCEPT SELECT state_id + 1, part FROM st), b AS (SELECT state_id + 1 AS state_id, part FROM st WHERE state_id < (SELECT max(state_id) FROM st) EXCEPT SELECT state_id, part FROM st)"
    " SELECT state_id, part, 'admit' AS change FROM a UNION ALL SELECT state_id, part, 'evict' FROM b",
    "buffer_map": f"WITH {_STATES}, s AS (SELECT DISTINCT state_id FROM st) SELECT s.state_id, p_partkey AS id, coalesce(slot * {_SIZE} + p_partkey - st.part * {_SIZE}, -1)::BIGINT AS slot_id"
    f" FROM part CROSS JOIN s LEFT JOIN st ON st.state_id = s.state_id AND st.part = p_partkey // {_SIZE}",
    "nbrs_all_out": f"WITH {TYPED}, {_CUST}, {_OUT} SELECT * FROM nb",
    "nbrs_all_in": f"WITH {TYPED}, {_PART}, {_IN} SELECT * FROM nb",
    "nbrs_uniform_k": f"WITH {TYPED}, {_PART}, {_IN}, r AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY {digest_sql(21, 'center', 'edge_id')}, edge_id) AS rn FROM nb) SELECT center, nbr, rel, edge_id FROM r WHERE rn <= 5",
    "nbrs_with_replacement": f"WITH {TYPED}, {_PART}, {_IN}, r AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY {digest_sql(22, 'center', 'edge_id')}, edge_id) - 1 AS pos, count(*) OVER (PARTITION BY center) AS degree FROM nb),"
    f" k AS (SELECT center, {draw_sql(23, 'center', 'k')} % degree AS pos FROM (SELECT DISTINCT center, degree FROM r WHERE degree > 20), range(20) t(k))"
    " SELECT center, nbr, rel, edge_id FROM r WHERE degree <= 20 UNION ALL SELECT r.center, nbr, rel, edge_id FROM k JOIN r ON r.center = k.center AND r.pos = k.pos",
    "nbrs_dropout": f"WITH {TYPED}, {_PART}, {_IN} SELECT * FROM nb WHERE {unit_sql(23, 'center', 'edge_id')} >= 0.3",
    "khop_frontier": f"WITH {TYPED}, {_HOPS} SELECT node, 0 AS hop FROM roots UNION ALL SELECT node, 1 FROM f1 UNION ALL SELECT node, 2 FROM f2",
    "khop_edges": f"WITH {TYPED}, {_HOPS} SELECT center, nbr, rel, edge_id, incoming, 1 AS hop FROM h1 UNION ALL SELECT center, nbr, rel, edge_id, incoming, 2 FROM h2",
    "next_layer_edges": f"WITH {TYPED}, {_HOPS} SELECT center, count(*) AS n_neighbours FROM h1 GROUP BY center",
    "combined_neighbours": f"WITH {TYPED}, b AS (SELECT src AS center, dst AS nbr FROM e WHERE src IN (SELECT 'c' || c_custkey FROM customer) UNION ALL SELECT dst, src FROM e) SELECT center, count(*) AS n_neighbours, count(DISTINCT nbr) AS n_distinct FROM b GROUP BY center",
    "local_ids": f"WITH {INT}, {_BATCHED}, {_LOCAL} SELECT * FROM li",
    "local_edges": f"WITH {INT}, {_BATCHED}, {_LOCAL} SELECT edge_id, p.batch_id, a.local_id AS local_src, b.local_id AS local_dst FROM p JOIN li a ON a.batch_id = p.batch_id AND a.node = src JOIN li b ON b.batch_id = p.batch_id AND b.node = dst",
    "negatives_uniform": f"WITH {_UNIFORM} SELECT * FROM un",
    "negatives_degree": f"WITH {_CHUNKED}, {_negatives('dk', PER_CHUNK)}, dn AS (SELECT chunk_id, neg_id, {draw_sql(42, 'chunk_id', 'neg_id')} % (SELECT count(*) FROM ge) AS edge_pos FROM dk) SELECT dn.chunk_id, neg_id, dst AS node, edge_pos FROM dn JOIN gp ON pos = edge_pos",
    "negatives_mixed": f"WITH {_CHUNKED}, {_MIXED} SELECT * FROM mx",
    "local_filter": f"WITH {_CHUNKED}, {_UNIFORM} SELECT gc.edge_id, neg_id FROM gc JOIN un ON un.chunk_id = gc.chunk_id JOIN g ON g.src = gc.src AND g.rel = gc.rel AND g.dst = un.node",
    "degree_filter": f"WITH {_CHUNKED}, {_MIXED} SELECT gc.edge_id, neg_id FROM mx JOIN gc ON gc.pos = mx.edge_pos WHERE gc.chunk_id = mx.chunk_id",
    **{k: f"SELECT a::INTEGER AS src_part, b::INTEGER AS dst_part FROM range({PARTS}) x(a), range({PARTS}) y(b)" for k in ("order_beta", "order_two_level", "order_by_name")},
    "order_dispersed": f"SELECT k::INTEGER AS part FROM range({PARTS}) r(k)",
    "order_sequential": "SELECT k::INTEGER AS part, 0 AS state_id FROM (VALUES (1), (6)) t(k)",
    "known_edge_filter": f"WITH {TYPED} SELECT src, rel, count(DISTINCT dst) AS n_known FROM e GROUP BY 1, 2",
    "negatives_all_filtered": f"WITH {TYPED}, k AS (SELECT src, rel, count(DISTINCT dst) AS n FROM e GROUP BY 1, 2) SELECT edge_id, (SELECT count(*) FROM part) - n AS n_negatives FROM e JOIN k ON k.src = e.src AND k.rel = e.rel",
    "known_edge_antijoin": f"WITH {TYPED}, s AS (SELECT edge_id, src, CASE rel WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'A' END AS rel, dst FROM e) SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = s.src AND e.rel = s.rel AND e.dst = s.dst)",
    "all_edges": f"WITH {TYPED} SELECT src, 2 * count(*) AS n_edges FROM e GROUP BY src",
}

# the same over all customers
