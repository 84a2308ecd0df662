"""From tables and raw labels to a dictionary-encoded, split edge table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.order import hash_positions
from loomgraph.session import written

# fixed values: entries that stand for a missing entity, after cleaning
INVALID = ("0", "", "none", "not reported")


def clean_token(c: Column) -> Column:
    """The label without surrounding white space, then without tabs, dots, quotes and spaces at its ends, in lower case; null is 'none'."""
    outer = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("none")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.lower(F.trim(outer, F.lit("\t.'\" ")))


def is_valid(c: Column) -> Column:
    return c.isNotNull() & ~c.isin(*INVALID)


def drop_invalid(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.filter(is_valid(F.col(src)) & is_valid(F.col(dst)))


def entity(table: str, column: str, c: Column) -> Column:
    """A label unique across tables."""
    return F.concat_ws("_", F.lit(table), F.lit(column), c)


def sql_to_edges(spark: SparkSession, queries: Sequence[tuple[str, str]], entities: Sequence[tuple[tuple[str, str], tuple[str, str]]]) -> DataFrame:
    """(src, rel, dst) from pairs of a relation and a SQL query with two columns, over registered views.

    `entities` names table and column of either end. Labels are cleaned, invalid ends dropped, and duplicates removed
    over all queries' rows, not per fetch.
    """
    parts = []
    for (rel, sql), (s, d) in zip(queries, entities):
        rows = spark.sql(sql).toDF("a", "b").select(clean_token(F.col("a")).alias("src"), clean_token(F.col("b")).alias("dst"))
        parts.append(drop_invalid(rows).select(entity(*s, F.col("src")).alias("src"), F.lit(rel).alias("rel"), entity(*d, F.col("dst")).alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates()


def canonical(df: DataFrame, src: str, dst: str, rel: str | None = None, weight: str | None = None, key: str | None = None) -> DataFrame:
    """(src, rel, dst, weight[, edge_id]): an untyped graph has the constant relation '0', an unweighted one null weights."""
    named = [F.col(src).alias("src"), (F.col(rel) if rel else F.lit("0")).alias("rel"), F.col(dst).alias("dst"), (F.col(weight) if weight else F.lit(None)).cast("double").alias("weight")]
    return df.select(*named, *([F.col(key).alias("edge_id")] if key else []))


def node_labels(edges: DataFrame, *known: DataFrame) -> DataFrame:
    """Distinct labels of src and dst, and of the tables in `known` (label)."""
    out = edges.select(F.explode(F.array("src", "dst")).alias("label"))
    for k in known:
        out = out.unionByName(k.select("label"))
    return out.filter(F.col("label").isNotNull()).distinct()


def node_dictionary(edges: DataFrame, seed: int = 0, train_nodes: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """(label, id): dense ids from 0 in hash order.

    With `train_nodes` (label) those get the lowest ids. With `first` (label, place) those get the ids 0, 1, ... by
    place, and all others follow. The distinct labels are written to the shared folder first: numbering them takes two
    looks at them, but only one at the edges.
    """
    labels = written(node_labels(edges, *([train_nodes] if train_nodes is not None else [])), "labels")
    if first is not None:
        first = written(first, "first")
        n = first.count()
        rest = hash_positions(labels.join(first.select("label"), "label", "left_anti"), seed, ["label"], "id")
        return first.select("label", F.col("place").cast("bigint").alias("id")).unionByName(rest.select("label", (F.col("id") + n).alias("id")))
    if train_nodes is not None:
        marked = labels.join(train_nodes.select("label", F.lit(0).alias("group")).distinct(), "label", "left")
        return hash_positions(marked, seed, ["label"], "id", major=F.coalesce(F.col("group"), F.lit(1))).select("label", "id")
    return hash_positions(labels, seed, ["label"], "id").select("label", "id")


def relation_dictionary(edges: DataFrame, seed: int = 0) -> DataFrame:
    labels = written(edges.select(F.col("rel").alias("label")).filter(F.col("label").isNotNull()).distinct(), "relations")
    return hash_positions(labels, seed, ["label"], "id").select("label", "id")


def encode_edges(edges: DataFrame, nodes: DataFrame, rels: DataFrame, how: str = "inner") -> DataFrame:
    """Replace the labels src, rel, dst by ids; the other columns stay. With how='left' unknown labels become null.

    Joins are left to the planner, which broadcasts a dictionary only below the session's size threshold. So that it
    knows the sizes, and a dictionary isn't made anew for each end, both are written to the shared folder.
    """
    nodes, rels = written(nodes.select("label", "id"), "nodes"), written(rels.select("label", "id"), "rels")
    rest = [c for c in edges.columns if c not in ("src", "rel", "dst")]
    side = lambda d, c: d.select(F.col("label").alias(c), F.col("id").alias(f"{c}_id"))
    joined = edges.join(side(rels, "rel"), "rel", how).join(side(nodes, "src"), "src", how).join(side(nodes, "dst"), "dst", how)
    return joined.select(F.col("src_id").alias("src"), F.col("rel_id").alias("rel"), F.col("dst_id").alias("dst"), *rest)


def apply_mapping(edges: DataFrame, nodes: DataFrame, rels: DataFrame, strict: bool = True) -> DataFrame:
    """Encode with existing dictionaries; an unknown label raises an error, or gives null if not strict."""
    out = encode_edges(edges, nodes, rels, "left")
    if not strict:
        return out
    check = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} holds a label that the dictionary lacks"))).otherwise(F.col(c)).alias(c)
    return out.select(*[check(c) if c in ("src", "rel", "dst") else F.col(c) for c in out.columns])


def remap_nodes(table: DataFrame, mapping: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """Re-key a node table (features, labels, split lists) to the ids of `mapping` (label, id); all mapped ids come out, missing labels as -1."""
    out = mapping.select(F.col("label").alias(key), "id").join(table, key, "left").drop(key)
    return out.withColumn(label, F.coalesce(F.col(label), F.lit(-1))) if label else out


def split_edges(edges: DataFrame, fractions: Sequence[float] = (0.9, 0.05, 0.05), names: Sequence[str] = ("train", "valid", "test"), seed: int = 0, key: str = "edge_id") -> DataFrame:
    """Append split: exact cut points int(n * f) in hash order; rows beyond the last cut (fractions below 1) are dropped."""
    placed = hash_positions(edges, seed, [key], "_pos", total="_total")
    split, end, ends = F.lit(None).cast("string"), F.lit(0), []
    for i, f in enumerate(fractions):
        whole = i == len(fractions) - 1 and abs(sum(fractions) - 1) < 1e-9
        end = F.col("_total") if whole else end + F.floor(F.col("_total") * F.lit(float(f)))
        ends.append(end)
    for name, end in reversed(list(zip(names, ends))):
        split = F.when(F.col("_pos") < end, F.lit(name)).otherwise(split)
    return placed.withColumn("split", split).filter(F.col("split").isNotNull()).drop("_pos", "_total")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree) of all nodes that have an edge: one shuffle for both directions."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def all_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """degrees() of every id in nodes (node), zero where there is no edge."""
    return nodes.join(degrees(edges), "node", "left").fillna(0, ["out_degree", "in_degree", "degree"])


def top_degree(edges: DataFrame, k: int) -> DataFrame:
    """(label, place): the k nodes of highest total degree, ties by label."""
    top = degrees(edges).orderBy(F.col("degree").desc(), "node").limit(k)
    return top.select(F.col("node").alias("label"), (F.row_number().over(W.orderBy(F.col("degree").desc(), "node")) - 1).alias("place"))  # k rows


def dataset_stats(edges: DataFrame) -> DataFrame:
    """One row: num_edges, num_nodes, num_relations, num_train, num_valid, num_test of edges with a split."""
    count = lambda s: F.sum(F.when(F.col("split") == s, 1).otherwise(0)).alias(f"num_{s}")
    nodes = node_labels(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))).agg(F.count(F.lit(1)).alias("num_nodes"))
    return edges.agg(F.count(F.lit(1)).alias("num_edges"), F.countDistinct("rel").alias("num_relations"), *map(count, ("train", "valid", "test"))).join(nodes)
