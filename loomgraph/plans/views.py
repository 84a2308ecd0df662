"""Graphs over the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.hashing import draw, draw_sql
from loomgraph.session import table


def _line_id():
    """Order and line don't identify a line; with part and supplier they do."""
    return ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000


def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Labelled edges customer -> part by return flag, weighted by quantity."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")  # noqa: E741
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        _line_id().alias("edge_id"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("src"),
        F.col("l_returnflag").alias("rel"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"),
        F.col("l_quantity").alias("weight"),
    )


TYPED = "e AS (SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS edge_id, 'c' || o_custkey AS src, l_returnflag AS rel, 'p' || l_partkey AS dst, l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def int_edges(spark: SparkSession, d: str) -> DataFrame:
    """Integer edges supplier -> part."""
    return table(spark, d, "lineitem").select(_line_id().alias("edge_id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


INT = "i AS (SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS edge_id, l_suppkey AS src, l_partkey AS dst FROM lineitem)"


def node_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"


def vector_edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct typed edges between the nodes of node_vectors: suppliers and parts folded onto them."""
    n = table(spark, d, "embeddings").count()
    rel = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, d, "lineitem").select(F.pmod("l_suppkey", F.lit(n)).alias("src"), rel.alias("rel"), F.pmod("l_partkey", F.lit(n)).alias("dst")).distinct()


VECTOR_EDGES = """g AS (SELECT DISTINCT l_suppkey % (SELECT count(*) FROM embeddings) AS src, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rel,
  l_partkey % (SELECT count(*) FROM embeddings) AS dst FROM lineitem)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """vector_edges with an edge_id: the whole of lineitem."""
    return vector_edges(spark, d).withColumn("edge_id", (F.col("src") * 3 + F.col("rel")) * 1_000_000 + F.col("dst"))


LINES = f"{VECTOR_EDGES}, f AS (SELECT *, (src * 3 + rel) * 1000000 + dst AS edge_id FROM g)"


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (edge_id, src, rel, dst) between the nodes of node_vectors: customers (0) and suppliers (1), folded onto them, and their nations."""
    n = F.lit(table(spark, d, "embeddings").count())
    c = table(spark, d, "customer").select(F.pmod("c_custkey", n).alias("src"), F.lit(0).cast("bigint").alias("rel"), F.col("c_nationkey").cast("bigint").alias("dst"))
    s = table(spark, d, "supplier").select(F.pmod("s_suppkey", n).alias("src"), F.lit(1).cast("bigint").alias("rel"), F.col("s_nationkey").cast("bigint").alias("dst"))
    return c.unionByName(s).distinct().withColumn("edge_id", (F.col("src") * 2 + F.col("rel")) * 1000 + F.col("dst"))


FACTS = """fd AS (SELECT c_custkey % (SELECT count(*) FROM embeddings) AS src, 0::BIGINT AS rel, c_nationkey::BIGINT AS dst FROM customer
  UNION SELECT s_suppkey % (SELECT count(*) FROM embeddings), 1, s_nationkey FROM supplier), f AS (SELECT *, (src * 2 + rel) * 1000 + dst AS edge_id FROM fd)"""


def hub_edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (edge_id, src, rel, dst) of the whole edge list between the nodes of node_vectors: labels as they stand are folded onto them by hash, so hubs stay hubs."""
    n = F.lit(table(spark, d, "embeddings").count())
    e = table(spark, d, "edge_list").select("src_column", "edge_type_column", "dst_column").na.drop()
    folded = e.select((draw("n", "src_column") % n).alias("src"), (draw("r", "edge_type_column") % 16).alias("rel"), (draw("n", "dst_column") % n).alias("dst")).distinct()
    return folded.withColumn("edge_id", (F.col("src") * 16 + F.col("rel")) * 1_000_000 + F.col("dst"))


HUB_EDGES = f"""hd AS (SELECT DISTINCT {draw_sql('n', 'src_column')} % (SELECT count(*) FROM embeddings) AS src, {draw_sql('r', 'edge_type_column')} % 16 AS rel, {draw_sql('n', 'dst_column')} % (SELECT count(*) FROM embeddings) AS dst
  FROM edge_list WHERE src_column IS NOT NULL AND edge_type_column IS NOT NULL AND dst_column IS NOT NULL), he AS (SELECT *, (src * 16 + rel) * 1000000 + dst AS edge_id FROM hd)"""
