"""Queries over the driver's tables, with equivalent SQL."""

from loomgraph.graph import Graph
from loomgraph.plans import batch_queries, data_quality, graph_queries, ingest_queries, io_queries, model_queries, views

_MODULES = (data_quality, ingest_queries, graph_queries, model_queries, io_queries, batch_queries)
CORE_QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
CORE_SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}


def flagship(spark, sf_dir):
    """Labelled edges from two tables, encoded and split; then the degrees of all nodes by label."""
    g = Graph.prepare(views.typed_edges(spark, sf_dir), seed=11)
    return g.degrees().withColumnRenamed("node", "id").join(g.nodes, "id").select("id", "label", "out_degree", "in_degree", "degree")
