"""Batches, buffer residents, initial values, and forward passes."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from loomgraph.functions.hashing import digest_sql, draw_sql, unit_sql
from loomgraph.functions.vectors import argmax
from loomgraph.operators import gnn, ingest, optim, partition, sampling, scoring
from loomgraph.operators.order import exclusive_sums, hash_positions, with_batches
from loomgraph.plans import graph_queries as g
from loomgraph.plans import model_queries as m
from loomgraph.plans.views import FACTS, INT, TYPED, VECTOR_EDGES, VECTORS, facts, int_edges, node_vectors, typed_edges, vector_edges
from loomgraph.session import shared_dir, table

BATCH = 1000


def resident_complement(spark, d):
    return partition.away(partition.states_table(spark, g.STATES), g.PARTS)


def active_nodes(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return partition.nodes_of_states(nodes, partition.states_table(spark, g.STATES), g._max_part(spark, d), g.PARTS, 80)


def negatives_both_ends(spark, d):
    return sampling.both_negatives(spark, 5, 20, table(spark, d, "embeddings").count(), 81)


def negative_edges(spark, d):
    known = vector_edges(spark, d)
    return sampling.negative_edges(spark, 5000, table(spark, d, "embeddings").count(), 3, known, 82)


def random_nodes(spark, d):
    return sampling.random_nodes(spark, 1000, table(spark, d, "part").count(), 83)


def batch_nodes(spark, d):
    e = int_edges(spark, d)
    placed = with_batches(hash_positions(e, 14, ["edge_id"]), BATCH)
    n = -(-e.count() // BATCH)
    return sampling.batch_nodes(placed, sampling.uniform_negatives(spark, n, 50, g._max_part(spark, d), 84))


def node_batches(spark, d):
    """Labelled nodes by batch."""
    v = node_vectors(spark, d).select("id", "label")
    return with_batches(hash_positions(v, 85, ["id"]), 100).select("id", "label", "batch_id")


def segment_ids(spark, d):
    """Degree offsets of nodes, and back from offsets to one row an edge."""
    deg = exclusive_sums(vector_edges(spark, d).groupBy("src").agg(F.count(F.lit(1)).alias("n")), ["src"], "n")
    return deg.select("src", F.explode(F.sequence(F.col("offset_before"), F.col("offset_before") + F.col("n") - 1)).alias("row_id"))


def edge_count(spark, d):
    return typed_edges(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rel").alias("n_rels"))


def known_map(spark, d):
    """Edges after dropping those whose relation or ends an existing dictionary lacks."""
    e = typed_edges(spark, d)
    nodes = ingest.node_dictionary(e.filter("rel <> 'N'"), 7)
    return ingest.encode_edges(e, nodes, ingest.relation_dictionary(e, 7)).select("edge_id", "src", "rel", "dst")


def init_normal(spark, d):
    return m._exploded(optim.normal_vectors(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), 8, 0.5, optim.glorot_limit(100, 8), 86))


def init_constant(spark, d):
    return m._exploded(optim.constant_vectors(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), 3, 1.0))


def dropout(spark, d):
    return m._exploded(optim.dropout(m._nodes(spark, d), 0.3, 87))


def sanity(spark, d):
    return optim.unsound(m._nodes(spark, d), -0.2, 0.2)


def _encoded(spark, d):
    return gnn.post(gnn.sage_gcn(m._nodes(spark, d), m._pairs(spark, d), m._w("a") * 8), activation="relu")


def forward_links(spark, d):
    """Encoded nodes, then scores of edges under encoded relations."""
    n = _encoded(spark, d)
    return m._rounded(scoring.edge_scores(facts(spark, d), n, n.select(F.col("id").alias("rel"), "vec"), "distmult").select("edge_id", "score"), "score")


def forward_classes(spark, d):
    """The class of each node by its encoded vector, the node decoder being none."""
    out = _encoded(spark, d).select("id", F.transform("vec", lambda x: F.round(x, 9)).alias("vec"))
    return out.select("id", argmax(F.col("vec")).alias("y_pred"))


def encoded_nodes(spark, d):
    p = f"{shared_dir(spark)}/encoded-{uuid.uuid4().hex}"
    _encoded(spark, d).write.parquet(p)
    return m._exploded(spark.read.parquet(p))


def score_pos_and_neg(spark, d):
    """Scores of edges and of as many given negative edges."""
    e = facts(spark, d).withColumn("kind", F.lit("pos"))
    neg = e.select("edge_id", "src", "rel", ((F.col("dst") + 1) % 25).alias("dst"), F.lit("neg").alias("kind"))
    both = scoring.edge_scores(e.select(neg.columns).unionByName(neg), m._nodes(spark, d), m._rels(spark, d), "transe")
    return m._rounded(both.select("edge_id", "kind", "score"), "score")


def gat_concat_layer(spark, d):
    heads = [(m._w(w, 4), m._w(a, 1, 4)[0] * 80, m._w(b, 1, 4)[0] * 80) for w, a, b in m._HEADS]
    return m._exploded(gnn.gat(m._nodes(spark, d), m._pairs(spark, d), heads, average=False))


QUERIES = {
    f.__name__: f
    for f in (
        resident_complement, active_nodes, negatives_both_ends, negative_edges, random_nodes, batch_nodes, node_batches, segment_ids, edge_count, known_map, init_normal, init_constant, dropout, sanity,
        forward_links, forward_classes, encoded_nodes, score_pos_and_neg, gat_concat_layer,
    )
}

from loomgraph.plans.ingest_queries import _ids  # noqa: E402

_N = "(SELECT count(*) FROM embeddings)"
_ENC = f"""{m._NB}, {m._SEG}, {m._FULL}, {m._mat("wa", "a")}, o AS ({m._matmul("sn", "(h + s) / (n + 1)", "wa", "8")}), en AS (SELECT id, pos, greatest(val, 0) AS val FROM o)"""
_GAT = m._gat_sql().rsplit(" SELECT a.id", 1)[0]
SQL = {
    "resident_complement": f"WITH {g._STATES}, s AS (SELECT DISTINCT state_id FROM st) SELECT state_id, k::INTEGER AS part FROM s, range({g.PARTS}) r(k) EXCEPT SELECT state_id, part FROM st",
    "active_nodes": f"WITH {g._STATES}, h AS (SELECT part, list(state_id ORDER BY state_id) AS states FROM st GROUP BY part) SELECT p_partkey AS id, states[1 + {draw_sql(80, 'p_partkey')} % len(states)] AS state_id FROM part JOIN h ON h.part = p_partkey // {g._SIZE}",
    "negatives_both_ends": " UNION ALL ".join(f"SELECT '{end}' AS end, k // 20 AS chunk_id, k % 20 AS neg_id, {draw_sql(81 + i, 'k // 20', 'k % 20')} % {_N} AS node FROM range(100) r(k)" for i, end in enumerate(("src", "dst"))),
    "negative_edges": f"WITH {VECTOR_EDGES}, x AS (SELECT {draw_sql(82, 'k', chr(39) + 's' + chr(39))} % {_N} AS src, ({draw_sql(82, 'k', chr(39) + 'r' + chr(39))} % 3)::INTEGER AS rel, {draw_sql(82, 'k', chr(39) + 'd' + chr(39))} % {_N} AS dst FROM range(5000) r(k))"
    " SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.src = x.src AND g.rel = x.rel AND g.dst = x.dst)",
    "random_nodes": f"SELECT k AS draw, {draw_sql(83, 'k')} % (SELECT count(*) FROM part) AS node FROM range(1000) r(k)",
    "batch_nodes": f"WITH {INT}, {g._BATCHED}, k AS (SELECT k // 50 AS batch_id, k % 50 AS neg_id FROM range(50 * (SELECT ceil(count(*) / {BATCH})::BIGINT FROM lineitem)) r(k)), u AS (SELECT batch_id, src AS node FROM p UNION SELECT batch_id, dst FROM p"
    f" UNION SELECT batch_id, {draw_sql(84, 'batch_id', 'neg_id')} % (SELECT max(p_partkey) + 1 FROM part) FROM k) SELECT batch_id, node, row_number() OVER (PARTITION BY batch_id ORDER BY node) - 1 AS local_id FROM u",
    "node_batches": f"WITH {VECTORS} SELECT id, label, (row_number() OVER (ORDER BY {digest_sql(85, 'id')}, id) - 1) // 100 AS batch_id FROM v",
    "segment_ids": f"WITH {VECTOR_EDGES} SELECT src, row_number() OVER (ORDER BY src) - 1 AS row_id FROM g",
    "edge_count": f"WITH {TYPED} SELECT count(*) AS n, count(DISTINCT rel) AS n_rels FROM e",
    "known_map": f"WITH {TYPED}, n AS (SELECT src AS label FROM e WHERE rel <> 'N' UNION SELECT dst FROM e WHERE rel <> 'N'), nd AS ({_ids('n', 7)}), rd AS ({_ids('(SELECT DISTINCT rel AS label FROM e)', 7)})"
    " SELECT edge_id, s.id AS src, rd.id AS rel, t.id AS dst FROM e JOIN nd s ON s.label = src JOIN nd t ON t.label = dst JOIN rd ON rd.label = rel",
    "init_normal": f"SELECT s_suppkey AS id, j AS pos, round(0.5 + sqrt(6 / 108.0) * sqrt(-2 * ln(1 - {unit_sql(86, 's_suppkey', chr(39) + chr(39) + ' || j || ' + chr(39) + 'u' + chr(39))})) * cos({unit_sql(86, 's_suppkey', chr(39) + chr(39) + ' || j || ' + chr(39) + 'v' + chr(39))} * {2 * math.pi!r}), 6) + 0.0 AS val FROM supplier, range(8) r(j)",
    "init_constant": "SELECT s_suppkey AS id, j AS pos, 1.0::DOUBLE AS val FROM supplier, range(3) r(j)",
    "dropout": f"WITH {VECTORS} SELECT id, pos - 1 AS pos, round(CASE WHEN {unit_sql(87, 'id', 'pos - 1')} >= 0.3 THEN vec[pos] / 0.7 ELSE 0 END, 6) + 0.0 AS val FROM v, range(1, 65) r(pos)",
    "sanity": f"WITH {VECTORS} SELECT sum((list_bool_or(list_transform(vec, lambda x: isnan(x))))::BIGINT)::BIGINT AS n_nan, sum((list_min(vec) < 0)::BIGINT)::BIGINT AS n_negative, sum((list_min(vec) < -0.2 OR list_max(vec) > 0.2)::BIGINT)::BIGINT AS n_outside FROM v",
    "forward_links": f"WITH {_ENC}, {FACTS} SELECT edge_id, round(sum(a.val * r.val * b.val), 6) + 0.0 AS score FROM f JOIN en a ON a.id = src JOIN en r ON r.id = rel AND r.pos = a.pos JOIN en b ON b.id = dst AND b.pos = a.pos GROUP BY edge_id",
    "forward_classes": f"WITH {_ENC}, x AS (SELECT id, pos, round(val, 9) AS val FROM en) SELECT id, arg_max(pos, (val, -pos))::INTEGER AS y_pred FROM x GROUP BY id",
    "encoded_nodes": f"WITH {_ENC} SELECT id, pos, round(val, 6) + 0.0 AS val FROM en",
    "score_pos_and_neg": f"WITH {VECTORS}, {FACTS}, b AS (SELECT edge_id, src, rel, dst, 'pos' AS kind FROM f UNION ALL SELECT edge_id, src, rel, (dst + 1) % 25, 'neg' FROM f) SELECT edge_id, kind, round({m._SCORES['transe']('s.vec', 'r.vec', 't.vec')}, 6) AS score FROM b JOIN v s ON s.id = src JOIN v t ON t.id = dst JOIN v r ON r.id = rel",
    "gat_concat_layer": f"{_GAT} SELECT id, pos, round(val, 6) + 0.0 AS val FROM at0 UNION ALL SELECT id, pos + 4, round(val, 6) + 0.0 FROM at1",
}
