"""Cleaning, encoding, splitting and statistics of edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.hashing import digest_sql
from loomgraph.operators import ingest as op
from loomgraph.operators.order import hash_positions, with_batches, with_chunks
from loomgraph.plans.views import INT, TYPED, VECTORS, int_edges, node_vectors, typed_edges
from loomgraph.session import table, written

PLACE_QUERIES = (
    ("located_in", "SELECT nation.n_name, region.r_name FROM nation, region WHERE nation.n_regionkey = region.r_regionkey"),
    ("supplies_from", "SELECT supplier.s_name, nation.n_name FROM supplier, nation WHERE supplier.s_nationkey = nation.n_nationkey"),
    ("lives_in", "SELECT customer.c_name, nation.n_name FROM customer, nation WHERE customer.c_nationkey = nation.n_nationkey"),
)
PLACE_ENTITIES = ((("nation", "n_name"), ("region", "r_name")), (("supplier", "s_name"), ("nation", "n_name")), (("customer", "c_name"), ("nation", "n_name")))


def edges_from_sql(spark, d):
    for t in ("nation", "region", "supplier", "customer"):
        table(spark, d, t).createOrReplaceTempView(t)
    return op.sql_to_edges(spark, PLACE_QUERIES, PLACE_ENTITIES)


def _cleaned(spark, d):
    return table(spark, d, "edge_list").select(
        "edge_id", op.clean_token(F.col("src_column")).alias("src"), op.clean_token(F.col("edge_type_column")).alias("rel"), op.clean_token(F.col("dst_column")).alias("dst")
    )


def clean_tokens(spark, d):
    return _cleaned(spark, d)


def drop_invalid(spark, d):
    return op.drop_invalid(_cleaned(spark, d))


def dedup_edges(spark, d):
    return op.drop_invalid(_cleaned(spark, d)).select("src", "rel", "dst").dropDuplicates()


def canonical_edges(spark, d):
    return op.canonical(table(spark, d, "edge_list"), "src_column", "dst_column", "edge_type_column", "edge_weight_column", "edge_id")


def cast_edges(spark, d):
    return int_edges(spark, d).select("edge_id", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))


def edge_weights(spark, d):
    return typed_edges(spark, d).select("edge_id", F.col("weight").cast("float").cast("double").alias("weight"))


def edge_range(spark, d):
    placed = hash_positions(typed_edges(spark, d), 5, ["edge_id"])
    return placed.withColumn("slot", F.floor(F.col("pos") / 10000).cast("bigint")).groupBy("slot").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum(F.col("edge_id") % 1000003).alias("sum_edge_id"))


def node_dictionary(spark, d):
    return op.node_dictionary(typed_edges(spark, d), 7)


def rel_dictionary(spark, d):
    return op.relation_dictionary(typed_edges(spark, d), 7)


def encode_edges(spark, d):
    e = written(typed_edges(spark, d), "edges")  # read for both dictionaries and for encoding
    return op.encode_edges(e, op.node_dictionary(e, 7), op.relation_dictionary(e, 7))


def apply_mapping(spark, d):
    nodes = table(spark, d, "node_mapping").groupBy(op.clean_token(F.col("node_label")).alias("label")).agg(F.min("node_id").alias("id"))
    rels = table(spark, d, "relation_mapping").groupBy(op.clean_token(F.col("relation_label")).alias("label")).agg(F.min("relation_id").alias("id"))
    return op.apply_mapping(_cleaned(spark, d), nodes, rels, strict=False)


def remap_nodes(spark, d):
    v = node_vectors(spark, d)
    mapping = hash_positions(v.select(F.col("id").alias("label")), 3, ["label"], "id")
    return op.remap_nodes(v.select(F.col("id").alias("vec_id"), "label"), mapping, "vec_id", "label").select("id", "label")


def split_three_way(spark, d):
    return op.split_edges(typed_edges(spark, d), seed=11).select("edge_id", "split")


def split_two_way(spark, d):
    return op.split_edges(typed_edges(spark, d), (0.8, 0.1), ("train", "test"), seed=12).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("edge_id") % 1000003).alias("sum_edge_id"))


def shuffle_batches(spark, d):
    return with_batches(hash_positions(typed_edges(spark, d), 13, ["edge_id"]), 1000).select("edge_id", "batch_id")


def negative_chunks(spark, d):
    e = int_edges(spark, d)
    return with_chunks(hash_positions(e, 14, ["edge_id"]), 10, e.count()).select("edge_id", "chunk_id")


def degree_in_out(spark, d):
    return op.degrees(typed_edges(spark, d)).select("node", "out_degree", "in_degree")


def degree_total(spark, d):
    nodes = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node")).unionByName(table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node")))
    return op.all_degrees(nodes, typed_edges(spark, d)).select("node", "degree")


def max_degree(spark, d):
    return op.degrees(typed_edges(spark, d)).agg(F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in"), F.count(F.lit(1)).alias("n_nodes"))


def topk_degree_ids(spark, d):
    e = typed_edges(spark, d)
    return op.node_dictionary(e, 7, first=op.top_degree(e, 100))


def sequential_train_ids(spark, d):
    e = typed_edges(spark, d)
    train = e.filter(F.col("rel") == "R").select(F.col("src").alias("label")).distinct()
    return op.node_dictionary(e, 7, train_nodes=train)


def dataset_stats(spark, d):
    return op.dataset_stats(op.split_edges(typed_edges(spark, d), seed=11))


def distinct_nodes(spark, d):
    return op.node_labels(typed_edges(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        edges_from_sql, clean_tokens, drop_invalid, dedup_edges, canonical_edges, cast_edges, edge_weights, edge_range, node_dictionary, rel_dictionary, encode_edges, apply_mapping, remap_nodes,
        split_three_way, split_two_way, shuffle_batches, negative_chunks, degree_in_out, degree_total, max_degree, topk_degree_ids, sequential_train_ids, dataset_stats, distinct_nodes,
    )
}


def clean_sql(c: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({c}::VARCHAR, 'none'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), chr(9) || '.''\" '))"


_CLEAN = f"c AS (SELECT edge_id, {clean_sql('src_column')} AS src, {clean_sql('edge_type_column')} AS rel, {clean_sql('dst_column')} AS dst FROM edge_list)"
_OK = "src NOT IN ('0', '', 'none', 'not reported') AND dst NOT IN ('0', '', 'none', 'not reported')"
_LABELS = "n AS (SELECT src AS label FROM e UNION SELECT dst FROM e)"


def _ids(source: str, seed: int, first: str = "") -> str:
    return f"SELECT label, row_number() OVER (ORDER BY {first}{digest_sql(seed, 'label')}, label) - 1 AS id FROM {source}"


_PLACED = lambda seed, source="e": f"p AS (SELECT *, row_number() OVER (ORDER BY {digest_sql(seed, 'edge_id')}, edge_id) - 1 AS pos, count(*) OVER () AS total FROM {source})"
_SPLIT = "CASE WHEN pos < floor(total * 0.9) THEN 'train' WHEN pos < floor(total * 0.9) + floor(total * 0.05) THEN 'valid' ELSE 'test' END"
_DEGREES = "dg AS (SELECT node, sum(o) AS out_degree, sum(i) AS in_degree, count(*) AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node)"

def place_sql(n: int) -> str:
    """Edges of the first n of PLACE_QUERIES."""
    return " UNION ".join(
        f"SELECT '{s[0]}_{s[1]}_' || {clean_sql('a')} AS src, '{rel}' AS rel, '{t[0]}_{t[1]}_' || {clean_sql('b')} AS dst FROM (SELECT {q[7:].split(' FROM ')[0].split(', ')[0]} AS a, {q[7:].split(' FROM ')[0].split(', ')[1]} AS b FROM {q.split(' FROM ')[1]})"
        f" WHERE {clean_sql('a')} NOT IN ('0', '', 'none', 'not reported') AND {clean_sql('b')} NOT IN ('0', '', 'none', 'not reported')"
        for (rel, q), (s, t) in list(zip(PLACE_QUERIES, PLACE_ENTITIES))[:n]
    )


SQL = {
    "edges_from_sql": place_sql(3),
    "clean_tokens": f"WITH {_CLEAN} SELECT * FROM c",
    "drop_invalid": f"WITH {_CLEAN} SELECT * FROM c WHERE {_OK}",
    "dedup_edges": f"WITH {_CLEAN} SELECT DISTINCT src, rel, dst FROM c WHERE {_OK}",
    "canonical_edges": "SELECT src_column AS src, edge_type_column AS rel, dst_column AS dst, edge_weight_column AS weight, edge_id FROM edge_list",
    "cast_edges": f"WITH {INT} SELECT edge_id, src::INTEGER AS src, dst::INTEGER AS dst FROM i",
    "edge_weights": f"WITH {TYPED} SELECT edge_id, weight::FLOAT::DOUBLE AS weight FROM e",
    "edge_range": f"WITH {TYPED}, {_PLACED(5)} SELECT pos // 10000 AS slot, min(pos) AS first_pos, max(pos) AS last_pos, sum(edge_id % 1000003)::BIGINT AS sum_edge_id FROM p GROUP BY 1",
    "node_dictionary": f"WITH {TYPED}, {_LABELS} {_ids('n', 7)}",
    "rel_dictionary": f"WITH {TYPED} {_ids('(SELECT DISTINCT rel AS label FROM e)', 7)}",
    "encode_edges": f"WITH {TYPED}, {_LABELS}, nd AS ({_ids('n', 7)}), rd AS ({_ids('(SELECT DISTINCT rel AS label FROM e)', 7)})"
    " SELECT s.id AS src, rd.id AS rel, t.id AS dst, edge_id, weight FROM e JOIN nd s ON s.label = src JOIN nd t ON t.label = dst JOIN rd ON rd.label = rel",
    "apply_mapping": f"WITH {_CLEAN}, nd AS (SELECT {clean_sql('node_label')} AS label, min(node_id) AS id FROM node_mapping GROUP BY 1), rd AS (SELECT {clean_sql('relation_label')} AS label, min(relation_id) AS id FROM relation_mapping GROUP BY 1)"
    " SELECT s.id AS src, rd.id AS rel, t.id AS dst, edge_id FROM c LEFT JOIN nd s ON s.label = src LEFT JOIN nd t ON t.label = dst LEFT JOIN rd ON rd.label = rel",
    "remap_nodes": f"WITH {VECTORS} SELECT row_number() OVER (ORDER BY {digest_sql(3, 'id')}, id) - 1 AS id, coalesce(label, -1) AS label FROM v",
    "split_three_way": f"WITH {TYPED}, {_PLACED(11)} SELECT edge_id, {_SPLIT} AS split FROM p",
    "split_two_way": f"WITH {TYPED}, {_PLACED(12)}, s AS (SELECT edge_id, CASE WHEN pos < floor(total * 0.8) THEN 'train' WHEN pos < floor(total * 0.8) + floor(total * 0.1) THEN 'test' END AS split FROM p)"
    " SELECT split, count(*) AS n, sum(edge_id % 1000003)::BIGINT AS sum_edge_id FROM s WHERE split IS NOT NULL GROUP BY split",
    "shuffle_batches": f"WITH {TYPED}, {_PLACED(13)} SELECT edge_id, pos // 1000 AS batch_id FROM p",
    "negative_chunks": f"WITH {INT}, {_PLACED(14, 'i')} SELECT edge_id, pos // ceil(total / 10)::BIGINT AS chunk_id FROM p",
    "degree_in_out": f"WITH {TYPED}, {_DEGREES} SELECT node, out_degree::BIGINT AS out_degree, in_degree::BIGINT AS in_degree FROM dg",
    "degree_total": f"WITH {TYPED}, {_DEGREES}, a AS (SELECT 'p' || p_partkey AS node FROM part UNION ALL SELECT 'c' || c_custkey FROM customer) SELECT a.node, coalesce(degree, 0) AS degree FROM a LEFT JOIN dg ON a.node = dg.node",
    "max_degree": f"WITH {TYPED}, {_DEGREES} SELECT max(out_degree)::BIGINT AS max_out, max(in_degree)::BIGINT AS max_in, count(*) AS n_nodes FROM dg",
    "topk_degree_ids": f"WITH {TYPED}, {_DEGREES}, r AS (SELECT node AS label, row_number() OVER (ORDER BY degree DESC, node) AS k FROM dg), rest AS (SELECT label FROM r WHERE k > 100)"
    f" SELECT label, k - 1 AS id FROM r WHERE k <= 100 UNION ALL SELECT label, id + 100 FROM ({_ids('rest', 7)})",
    "sequential_train_ids": f"WITH {TYPED}, {_LABELS}, t AS (SELECT DISTINCT src FROM e WHERE rel = 'R'), m AS (SELECT label, CASE WHEN label IN (SELECT src FROM t) THEN 0 ELSE 1 END AS late FROM n) {_ids('m', 7, 'late, ')}",
    "dataset_stats": f"WITH {TYPED}, {_LABELS}, {_PLACED(11)}, s AS (SELECT rel, {_SPLIT} AS split FROM p)"
    " SELECT count(*) AS num_edges, count(DISTINCT rel) AS num_relations, sum((split = 'train')::INT)::BIGINT AS num_train, sum((split = 'valid')::INT)::BIGINT AS num_valid, sum((split = 'test')::INT)::BIGINT AS num_test,"
    " (SELECT count(*) FROM n) AS num_nodes FROM s",
    "distinct_nodes": f"WITH {TYPED}, {_LABELS} SELECT label FROM n",
}
