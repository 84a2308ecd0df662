"""Round trips through files, and the graph facade."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from loomgraph.functions.hashing import digest_sql
from loomgraph.functions import vectors as V
from loomgraph.graph import Graph
from loomgraph.operators import ingest, partition, scoring
from loomgraph.operators.order import hash_positions
from loomgraph.plans import graph_queries, model_queries
from loomgraph.plans.ingest_queries import PLACE_QUERIES
from loomgraph.plans.views import FACTS, INT, LINES, TYPED, VECTORS, facts, int_edges, lines, node_vectors, typed_edges
from loomgraph.session import shared_dir, table
from loomgraph.sources import delimited, sinks
from loomgraph.streaming import updates


def _path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_delimited(spark, d):
    """Edges written with other columns between, a header, and read by position."""
    p = _path(spark, "edges")
    typed_edges(spark, d).select("edge_id", "src", F.lit("x").alias("note"), "rel", "dst", "weight").write.option("sep", "\t").option("header", True).csv(p)
    return delimited.read_delimited(spark, p, {"src_column": 1, "edge_type_column": 3, "dst_column": 4, "edge_weight_column": 5}, "\t", 1)


def write_buckets(spark, d):
    """Edges written by bucket, and a subgraph read back from its files alone."""
    p = _path(spark, "buckets")
    sinks.write_buckets(partition.with_parts(int_edges(spark, d), graph_queries._max_part(spark, d), graph_queries.PARTS), p, 4)
    return partition.induced_subgraph(spark.read.parquet(p), (0, 1)).select("edge_id", "src", "dst")


def export_embeddings(spark, d):
    v = node_vectors(spark, d)
    mapping = hash_positions(v.select(F.concat(F.lit("n"), "id").alias("label"), F.col("id").alias("old")), 3, ["label"], "id")
    vectors = v.select(F.col("id").alias("old"), "vec").join(mapping.select("old", "id"), "old").select("id", "vec")
    p = _path(spark, "embeddings")
    sinks.export_embeddings(vectors, mapping.select("label", "id"), p)
    return model_queries._exploded(spark.read.parquet(p).withColumnRenamed("embedding", "vec"))


def export_embeddings_csv(spark, d):
    v = node_vectors(spark, d)
    p = _path(spark, "embeddings")
    sinks.export_embeddings(v.select("id", "vec"), v.select(F.concat(F.lit("n"), "id").alias("label"), "id"), p, "csv")
    back = spark.read.schema("id string, embedding string").option("header", True).csv(p)
    return model_queries._exploded(back.select("id", F.transform(F.split("embedding", " "), lambda x: x.cast("double")).alias("vec")))


def scores_csv(spark, d):
    e = facts(spark, d)
    n, r = model_queries._nodes(spark, d), model_queries._rels(spark, d)
    scored = scoring.edge_scores(e, n, r, "distmult").join(scoring.all_node_ranks(e, n, r, "distmult", 64, known=e), "edge_id")
    p = _path(spark, "scores")
    sinks.write_scores(scored.withColumn("score", F.round("score", 6)), p)
    return spark.read.schema("src bigint, rel bigint, dst bigint, rank bigint, score double").option("header", True).csv(p)


def labels_csv(spark, d):
    p = _path(spark, "labels")
    sinks.write_labels(model_queries.predicted_classes(spark, d), p)
    return spark.read.schema("id bigint, y_pred int, y_true int").option("header", True).csv(p)


def checkpoint_resume(spark, d):
    """Two versions of node vectors, the second of which is found again."""
    p = _path(spark, "state")
    n = node_vectors(spark, d).select("id", "vec")
    sinks.save_state(n, p, 0)
    sinks.save_state(n.select("id", V.scale(F.col("vec"), 3.0).alias("vec")), p, 1)
    epoch, found = sinks.latest_state(spark, p)
    return found.select("id", F.lit(epoch).alias("epoch"), F.round(V.total(F.col("vec")), 6).alias("total"))


def prepared_graph(spark, d):
    return Graph.prepare(typed_edges(spark, d), seed=11).edges.select("edge_id", "src", "rel", "dst", "split")


def streamed_degrees(spark, d):
    """Degrees kept over a stream of the order table's files, customer by status."""
    p = _path(spark, "stream")
    source = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "o_orderstatus").alias("dst"))
    source.repartition(3, "src").write.parquet(f"{p}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{p}/in")
    updates.degrees_of_stream(stream, p).processAllAvailable()
    for q in spark.streams.active:
        if q.lastProgress is not None and p in str(q.lastProgress.get("sources", "")):
            q.stop()
    return updates.current(spark, p)


def pending_state(spark, d):
    """Orphan state after two batches, the second with all later events."""
    from loomgraph.operators import orphans

    cut = F.lit("2023-09-01").cast("timestamp_ntz")
    refs = orphans.references(table(spark, d, "edge_list"))
    events = orphans.all_parent_events(table(spark, d, "node_mapping"), table(spark, d, "relation_mapping"))
    first = orphans.advance(None, refs.filter(F.col("at") < cut), events.filter(F.col("at") < cut))
    return orphans.pending(orphans.advance(first, refs.filter(F.col("at") >= cut), events.filter(F.col("at") >= cut)))


def _small_edges(spark, d):
    """Suppliers and their nations, as arrays on the driver."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").orderBy("s_suppkey").toArrow()
    return np.stack([np.asarray(rows["s_suppkey"]), np.asarray(rows["s_nationkey"])], 1).astype(np.int64)


def array_edges(spark, d):
    e = _small_edges(spark, d)
    return delimited.from_array(spark, e, e[:, 0] / 4)


def binary_edges(spark, d):
    """All suppliers in a flat file of 32-bit numbers, read back."""
    p = _path(spark, "flat")
    rows = spark.createDataFrame([(bytearray(_small_edges(spark, d).astype("<i4").tobytes()),)], "content binary")
    put = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    out = put.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(put)
    out.write(bytearray(rows.first().content))
    out.close()
    return delimited.read_binary(spark, p, ("src", "dst"), "int32")


def custom_splits(spark, d):
    """Three files, one a split."""
    paths = []
    for rel in ("A", "N", "R"):
        paths.append(_path(spark, "edges"))
        typed_edges(spark, d).filter(F.col("rel") == rel).select("src", "rel", "dst").write.option("sep", "\t").csv(paths[-1])
    e = delimited.custom_dataset(spark, paths, {"src_column": 0, "edge_type_column": 1, "dst_column": 2})
    return e.groupBy("split", "src").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("n_dst"))


def edges_from_query_file(spark, d):
    """A query file, its pairs checked, run and turned into edges."""
    for t in ("nation", "region", "supplier"):
        table(spark, d, t).createOrReplaceTempView(t)
    text = "\n".join(x for pair in PLACE_QUERIES[:2] for x in pair)
    pairs = delimited.query_pairs(text)
    return ingest.sql_to_edges(spark, pairs, [delimited.query_entities(q) for _, q in pairs])


def metrics_csv(spark, d):
    """Metrics beside the scores: (metric, value)."""
    p = _path(spark, "metrics")
    sinks.write_metrics(model_queries.rank_filtered(spark, d), {m: scoring.metric(m) for m in ("MRR", "HITS@10")}, p)
    return spark.read.schema("metric string, value double").option("header", True).csv(p).withColumn("value", F.round("value", 6))


def model_copy(spark, d):
    p = _path(spark, "model")
    n = node_vectors(spark, d).select("id", "vec")
    sinks.export_model(n, n.select(F.lit("rel").alias("kind"), "id", "vec"), p)
    return spark.read.parquet(f"{p}/rels").select("kind", "id", F.round(V.total(F.col("vec")), 6).alias("total"))


def graph_batches(spark, d):
    """(batch, n_edges, first): batch after batch over all edges of vector_edges, none left out and none twice."""
    e = lines(spark, d)
    size = -(-e.count() // 4)
    g = Graph(e, node_vectors(spark, d).select("id"), None)
    out = None
    for b in g.batches(size, split=None, seed=5):
        one = b.edges.agg(F.count(F.lit(1)).alias("n_edges"), F.min("edge_id").alias("first")).select(F.lit(b.number).alias("batch"), "n_edges", "first")
        one = spark.createDataFrame(one.collect(), one.schema)
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (array_edges, binary_edges, custom_splits, edges_from_query_file, metrics_csv, model_copy, graph_batches, read_delimited, write_buckets, export_embeddings, export_embeddings_csv, scores_csv, labels_csv, checkpoint_resume, prepared_graph, streamed_degrees, pending_state)}

from loomgraph.plans.data_quality import _EVENTS  # noqa: E402
from loomgraph.plans.ingest_queries import _LABELS, _PLACED, _SPLIT, _ids, place_sql  # noqa: E402

_SZ = graph_queries._SIZE
SQL = {
    "array_edges": "SELECT s_suppkey::BIGINT AS src, 0::BIGINT AS rel, s_nationkey::BIGINT AS dst, s_suppkey / 4.0 AS weight FROM supplier",
    "binary_edges": "SELECT s_suppkey::INTEGER AS src, s_nationkey::INTEGER AS dst FROM supplier",
    "edges_from_query_file": place_sql(2),
    "custom_splits": f"WITH {TYPED} SELECT CASE rel WHEN 'A' THEN 'train' WHEN 'N' THEN 'valid' ELSE 'test' END AS split, src, count(*) AS n, count(DISTINCT dst) AS n_dst FROM e GROUP BY 1, 2",
    "metrics_csv": f"WITH {model_queries._ranked('distmult')} SELECT metric, round(value, 6) AS value FROM (SELECT 'n' AS metric, count(*)::DOUBLE AS value FROM fl UNION ALL SELECT 'MRR', avg(1.0 / rank) FROM fl UNION ALL SELECT 'HITS@10', avg((rank <= 10)::INT) FROM fl)",
    "model_copy": f"WITH {VECTORS} SELECT 'rel' AS kind, id, round(list_sum(vec), 6) AS total FROM v",
    "graph_batches": f"WITH {VECTORS}, {LINES}, p AS (SELECT edge_id, (row_number() OVER (ORDER BY {digest_sql('5:0', 'edge_id')}, edge_id) - 1) // ceil(count(*) OVER () / 4)::BIGINT AS batch FROM f) SELECT batch, count(*) AS n_edges, min(edge_id) AS first FROM p GROUP BY batch",
    "read_delimited": f"WITH {TYPED} SELECT src, rel, dst, weight FROM e",
    "write_buckets": f"WITH {INT} SELECT edge_id, src, dst FROM i WHERE src // {_SZ} IN (0, 1) AND dst // {_SZ} IN (0, 1)",
    "export_embeddings": f"WITH {VECTORS} SELECT 'n' || id AS id, pos - 1 AS pos, round(vec[pos], 6) + 0.0 AS val FROM v, range(1, 65) r(pos)",
    "export_embeddings_csv": f"WITH {VECTORS} SELECT 'n' || id AS id, pos - 1 AS pos, round(vec[pos], 6) + 0.0 AS val FROM v, range(1, 65) r(pos)",
    "scores_csv": f"WITH {model_queries._ranked('distmult')} SELECT src, rel, dst, rank, round({model_queries._SCORES['distmult']('vs', 'vr', 'vd')}, 6) AS score FROM fx JOIN fl ON fl.edge_id = fx.edge_id",
    "labels_csv": f"WITH {model_queries._LOGITS} SELECT id, y_pred, y_true FROM pc",
    "checkpoint_resume": f"WITH {VECTORS} SELECT id, 1 AS epoch, round(3 * list_sum(vec), 6) AS total FROM v",
    "prepared_graph": f"WITH {TYPED}, {_LABELS}, nd AS ({_ids('n', 11)}), rd AS ({_ids('(SELECT DISTINCT rel AS label FROM e)', 11)}), {_PLACED(11)}"
    f" SELECT edge_id, s.id AS src, rd.id AS rel, t.id AS dst, {_SPLIT} AS split FROM p JOIN nd s ON s.label = src JOIN nd t ON t.label = dst JOIN rd ON rd.label = rel",
    "streamed_degrees": "SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM (SELECT 'c' || o_custkey AS node, 1 AS o, 0 AS i FROM orders UNION ALL SELECT 's' || o_orderstatus, 0, 1 FROM orders) GROUP BY node",
    "pending_state": f"{_EVENTS}, live AS (SELECT parent, label, count(*) AS n FROM held WHERE removed_at IS NULL OR removed_at > '2100-01-01' GROUP BY 1, 2)"
    " SELECT refs.parent, count(DISTINCT refs.label) AS n_labels, count(*) AS n_refs FROM refs LEFT JOIN live ON live.parent = refs.parent AND live.label = refs.label WHERE refs.label IS NOT NULL AND live.n IS NULL GROUP BY 1",
}
