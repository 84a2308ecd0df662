"""Neighbours, multi-hop frontiers and negatives, drawn by hash so that a seed fixes the result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.hashing import digest, draw, unit
from loomgraph.session import sent_if_small, written


#: edges in one part of a hub, if all edges are its own
PART_EDGES = 1_000_000


@dataclass(frozen=True)
class Hop:
    """kind: all, uniform (at most n without replacement), replaced (n draws with replacement), dropout (keep with 1 - rate)."""

    kind: str = "all"
    n: int = 0
    rate: float = 0.0


def neighbours(frontier: DataFrame, edges: DataFrame, incoming: bool) -> DataFrame:
    """(center, nbr, rel, edge_id, incoming): every edge into, or out of, the nodes of frontier (node); repeats are kept."""
    at, far = ("dst", "src") if incoming else ("src", "dst")
    found = edges.join(frontier.select(F.col("node").alias("center")), F.col(at) == F.col("center"))
    return found.select("center", F.col(far).alias("nbr"), "rel", "edge_id", F.lit(incoming).alias("incoming"))


def sampled(found: DataFrame, hop: Hop, seed: int = 0) -> DataFrame:
    """Of each center's neighbours in one direction, those that the hop keeps."""
    if hop.kind == "all":
        return found
    if hop.kind == "dropout":
        return found.filter(unit(seed, "center", "edge_id") >= F.lit(hop.rate))
    if hop.kind == "uniform":
        # the planner limits each center's rows before the shuffle, so hubs send n rows per task
        w = W.partitionBy("center").orderBy(digest(seed, "center", "edge_id"), "edge_id")
        return found.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= hop.n).drop("_rn")
    if hop.kind == "replaced":
        return _with_replacement(found, hop.n, seed)
    raise ValueError(f"no such hop: {hop.kind}")


def _with_replacement(found: DataFrame, n: int, seed: int) -> DataFrame:
    """All neighbours of centers with at most n; of others n draws of a position.

    Positions are counted within (center, first digits of the digest), with offsets from the counts of a center, so a
    hub's edges are spread over 16 tasks, or 256 and more where there are more than PART_EDGES for each.
    """
    found = written(found, "neighbours")  # looked at three times
    digits, n_found = 1, found.count()
    while 16**digits * PART_EDGES < n_found:
        digits += 1
    d = found.withColumn("_d", digest(seed, "center", "edge_id")).withColumn("_b", F.substring("_d", 1, digits))
    counts = d.groupBy("center", "_b").agg(F.count(F.lit(1)).alias("_n"))
    by = W.partitionBy("center")
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(by.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("degree", F.sum("_n").over(by))
    placed = (
        d.withColumn("_rn", F.row_number().over(W.partitionBy("center", "_b").orderBy("_d", "edge_id")))
        .join(offsets.select("center", "_b", "_o", "degree"), ["center", "_b"])
        .withColumn("_pos", F.col("_o") + F.col("_rn") - 1)
    )
    few = placed.filter(F.col("degree") <= n)
    large = offsets.select("center", "degree").distinct().filter(F.col("degree") > n)
    draws = large.select("center", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k"), "degree").select("center", (draw(seed + 1, "center", "_k") % F.col("degree")).alias("_pos"))
    many = placed.filter(F.col("degree") > n).join(draws, ["center", "_pos"])
    kept = found.columns
    return few.select(*kept).unionByName(many.select(*kept))


def layered(roots: DataFrame, edges: DataFrame, hops: Sequence[Hop], incoming: bool = True, outgoing: bool = True, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(hop, node) and (hop, center, nbr, rel, edge_id, incoming) of a multi-hop neighbourhood; roots (node) are hop 0.

    A hop samples around the nodes that the one before found new, so each node is expanded once. The links and
    new nodes of all hops but the last are written to the shared folder; otherwise a hop would repeat all before it.
    """
    frontier = roots.select("node").distinct()
    nodes, links = frontier.withColumn("hop", F.lit(0)), None
    for i, hop in enumerate(hops, 1):
        ways = [w for w, on in ((True, incoming), (False, outgoing)) if on]
        found = None
        for w in ways:
            part = sampled(neighbours(frontier, edges, w), hop, seed + 10 * i + w)
            found = part if found is None else found.unionByName(part)
        found = found.withColumn("hop", F.lit(i))
        keep = (lambda df, name: written(df, f"{name}-{i}")) if i < len(hops) else (lambda df, name: df)  # noqa: B023
        found = keep(found, "hop")
        links = found if links is None else links.unionByName(found)
        frontier = keep(found.select(F.col("nbr").alias("node")).distinct().join(nodes, "node", "left_anti"), "frontier")
        nodes = nodes.unionByName(frontier.withColumn("hop", F.lit(i)))
    return nodes, links


def next_layer(links: DataFrame, n_hops: int, layer: int) -> DataFrame:
    """Edges that layer `layer` (from 1) of n_hops computes: the outermost hops are dropped one by one."""
    return links.filter(F.col("hop") <= n_hops - layer + 1)


def local_ids(batches: DataFrame, columns: Sequence[str], batch: str = "batch_id") -> DataFrame:
    """(batch_id, node, local_id): the distinct ids of several columns of a batch, numbered in order."""
    nodes = batches.select(batch, F.explode(F.array(*columns)).alias("node")).distinct()
    return nodes.withColumn("local_id", (F.row_number().over(W.partitionBy(batch).orderBy("node")) - 1).cast("bigint"))


def uniform_negatives(spark: SparkSession, n_chunks: int, per_chunk: int, n_nodes: int, seed: int | str = 0) -> DataFrame:
    """(chunk_id, neg_id, node): per_chunk node ids for each chunk, with replacement."""
    k = spark.range(n_chunks * per_chunk).select(F.floor(F.col("id") / per_chunk).cast("bigint").alias("chunk_id"), (F.col("id") % per_chunk).alias("neg_id"))
    return k.withColumn("node", draw(seed, "chunk_id", "neg_id") % n_nodes)


def degree_negatives(spark: SparkSession, placed: DataFrame, n_edges: int, n_chunks: int, per_chunk: int, end: str = "dst", seed: int = 0) -> DataFrame:
    """(chunk_id, neg_id, node, edge_pos): ends of random edges of placed (pos), so nodes come up as often as their degree."""
    k = spark.range(n_chunks * per_chunk).select(F.floor(F.col("id") / per_chunk).cast("bigint").alias("chunk_id"), (F.col("id") % per_chunk).alias("neg_id"))
    drawn = k.withColumn("edge_pos", draw(seed, "chunk_id", "neg_id") % n_edges)
    return drawn.join(placed.select(F.col("pos").alias("edge_pos"), F.col(end).alias("node")), "edge_pos")


def mixed_negatives(spark: SparkSession, placed: DataFrame, n_edges: int, n_nodes: int, n_chunks: int, per_chunk: int, degree_fraction: float, end: str = "dst", seed: int = 0) -> DataFrame:
    """(chunk_id, neg_id, node, edge_pos): the first int(per_chunk * degree_fraction) by degree, the others even (edge_pos null)."""
    by_degree = int(per_chunk * degree_fraction)
    even = uniform_negatives(spark, n_chunks, per_chunk - by_degree, n_nodes, seed + 1).withColumn("neg_id", F.col("neg_id") + by_degree).withColumn("edge_pos", F.lit(None).cast("bigint"))
    if not by_degree:
        return even
    return degree_negatives(spark, placed, n_edges, n_chunks, by_degree, end, seed).select("chunk_id", "neg_id", "node", "edge_pos").unionByName(even)


def local_matches(chunked: DataFrame, negatives: DataFrame, known: DataFrame) -> DataFrame:
    """(edge_id, neg_id): negatives that make an edge with dst replaced equal to one in known (src, rel, dst)."""
    # known edges first: of all pairs of a chunk only those become rows that are known
    places = chunked.select("src", "rel", "chunk_id").distinct().join(known.select("src", "rel", "dst").distinct(), ["src", "rel"])
    hits = places.join(negatives.select("chunk_id", "neg_id", F.col("node").alias("dst")), ["chunk_id", "dst"])
    return chunked.select("edge_id", "src", "rel", "chunk_id").join(hits, ["src", "rel", "chunk_id"]).select("edge_id", "neg_id")


def own_chunk_matches(chunked: DataFrame, negatives: DataFrame, chunk_size: int) -> DataFrame:
    """(edge_id, neg_id): negatives drawn by degree from the very edge that they would corrupt, in its own chunk."""
    own = negatives.filter(F.col("edge_pos").isNotNull() & (F.floor(F.col("edge_pos") / chunk_size) == F.col("chunk_id")))
    return own.join(chunked.select("edge_id", F.col("pos").alias("edge_pos")), "edge_pos").select("edge_id", "neg_id")


def known_ends(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(src, rel, dst): every dst that known edges give for the src and rel of some query edge: the global filter, listed once for all edges of a src and rel."""
    return known.select("src", "rel", "dst").distinct().join(queries.select("src", "rel").distinct(), ["src", "rel"], "left_semi")


def filtered_negative_counts(queries: DataFrame, known: DataFrame, n_nodes: int) -> DataFrame:
    """(edge_id, n_negatives): how many of all nodes stay as negatives of an edge under the global filter, without listing them."""
    ends = known.select("src", "rel", "dst").distinct().groupBy("src", "rel").agg(F.count(F.lit(1)).alias("n_known"))
    return queries.join(ends, ["src", "rel"], "left").select("edge_id", (F.lit(n_nodes) - F.coalesce("n_known", F.lit(0))).alias("n_negatives"))


def drop_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidate edges (src, rel, dst) that no known edge equals."""
    return candidates.join(known.select("src", "rel", "dst").distinct(), ["src", "rel", "dst"], "left_anti")


def both_negatives(spark: SparkSession, n_chunks: int, per_chunk: int, n_nodes: int, seed: int | str = 0) -> DataFrame:
    """(end, chunk_id, neg_id, node): negatives in place of src, and others in place of dst."""
    parts = [uniform_negatives(spark, n_chunks, per_chunk, n_nodes, seed + k if isinstance(seed, int) else f"{seed}:{end}").withColumn("end", F.lit(end)) for k, end in enumerate(("src", "dst"))]
    return parts[0].unionByName(parts[1])


def negative_edges(spark: SparkSession, n: int, n_nodes: int, n_rels: int, known: DataFrame, seed: int = 0) -> DataFrame:
    """(src, rel, dst): n edges drawn evenly, less those that are known."""
    drawn = spark.range(n).select((draw(seed, "id", F.lit("s")) % n_nodes).alias("src"), (draw(seed, "id", F.lit("r")) % n_rels).cast("int").alias("rel"), (draw(seed, "id", F.lit("d")) % n_nodes).alias("dst"))
    return drop_known(drawn, known)


def random_nodes(spark: SparkSession, n: int, n_nodes: int, seed: int = 0) -> DataFrame:
    """(draw, node): n node ids, with replacement."""
    return spark.range(n).select(F.col("id").alias("draw"), (draw(seed, "id") % n_nodes).alias("node"))


def batch_nodes(placed: DataFrame, negatives: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch_id, node, local_id): distinct src, dst and negatives (chunk_id = batch_id) of each batch, numbered in order."""
    ends = placed.select(batch, F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = ends.unionByName(negatives.select(F.col("chunk_id").alias(batch), "node")).distinct()
    return nodes.withColumn("local_id", (F.row_number().over(W.partitionBy(batch).orderBy("node")) - 1).cast("bigint"))
