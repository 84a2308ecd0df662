"""A graph of DataFrames: prepare, partition, sample, score and evaluate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.vectors import argmax
from loomgraph.operators import gnn, ingest, partition, sampling, scoring, train
from loomgraph.operators.sampling import Hop
from loomgraph.session import written


@dataclass(frozen=True)
class Batch:
    """edges; negatives (end, chunk_id, neg_id, node) or None; nodes (node, hop), and links around them or None."""

    number: int
    edges: DataFrame
    negatives: DataFrame | None
    nodes: DataFrame
    links: DataFrame | None


@dataclass(frozen=True)
class Graph:
    """edges (edge_id, src, rel, dst[, weight][, split]) by id, with the dictionaries nodes and rels (label, id)."""

    edges: DataFrame
    nodes: DataFrame
    rels: DataFrame

    @staticmethod
    def prepare(labelled: DataFrame, fractions: Sequence[float] = (0.9, 0.05, 0.05), seed: int = 0, train_first: bool = False) -> Graph:
        """Encode and split labelled edges (edge_id, src, rel, dst, ...). With train_first, nodes of train edges get the lowest ids."""
        split = written(ingest.split_edges(labelled, fractions, seed=seed), "split")  # read for both dictionaries and for encoding
        train = ingest.node_labels(split.filter("split = 'train'")) if train_first else None
        nodes, rels = ingest.node_dictionary(split, seed, train_nodes=train), ingest.relation_dictionary(split, seed)
        return Graph(ingest.encode_edges(split, nodes, rels), nodes, rels)

    def split(self, name: str) -> DataFrame:
        return self.edges.filter(F.col("split") == name)

    def stats(self) -> DataFrame:
        return ingest.dataset_stats(self.edges)

    def degrees(self) -> DataFrame:
        return ingest.all_degrees(self.nodes.select(F.col("id").alias("node")), self.edges)

    def buckets(self, n_parts: int) -> DataFrame:
        return partition.with_parts(self.edges, self.nodes.count(), n_parts)

    def neighbourhood(self, roots: DataFrame, hops: Sequence[Hop], **ways: bool) -> tuple[DataFrame, DataFrame]:
        return sampling.layered(roots, self.edges, hops, **ways)

    def scores(self, vectors: DataFrame, rel_vectors: DataFrame, decoder: str, split: str = "test") -> DataFrame:
        return scoring.edge_scores(self.split(split), vectors, rel_vectors, decoder)

    def predict_links(self, vectors: DataFrame, rel_vectors: DataFrame, decoder: str, dim: int, split: str = "test", filtered: bool = True) -> DataFrame:
        """(edge_id, src, rel, dst, rank, score) of a split against all nodes; filtered leaves out all known edges."""
        e = self.split(split)
        r = scoring.all_node_ranks(e, vectors, rel_vectors, decoder, dim, self.edges if filtered else None)
        return scoring.edge_scores(e, vectors, rel_vectors, decoder).join(r, "edge_id").select("edge_id", "src", "rel", "dst", "rank", "score")

    def evaluate(self, vectors: DataFrame, rel_vectors: DataFrame, inverse_vectors: DataFrame, decoder: str, dim: int, split: str = "test", filtered: bool = True) -> DataFrame:
        """(edge_id, side, rank): two ranks for each edge of a split, against all nodes as dst and as src."""
        return scoring.both_side_ranks(self.split(split), vectors, rel_vectors, inverse_vectors, decoder, dim, self.edges if filtered else None)

    def batches(self, size: int, split: str | None = "train", seed: int = 0, epoch: int = 0, negatives: int = 0, hops: Sequence[Hop] = ()) -> Iterator[Batch]:
        """Batch after batch of an epoch: its edges in hash order, its negatives, and the nodes and links around all of their ends."""
        spark, n = self.edges.sparkSession, self.nodes.count()
        for b, e in enumerate(train.batches_of(self.edges if split is None else self.split(split), size, seed, epoch)):
            negs = sampling.both_negatives(spark, 1, negatives, n, f"{seed}:{epoch}:{b}") if negatives else None
            roots = e.select(F.explode(F.array("src", "dst")).alias("node"))
            roots = (roots if negs is None else roots.unionByName(negs.select("node"))).distinct()
            nodes, links = self.neighbourhood(roots, hops) if hops else (roots.withColumn("hop", F.lit(0)), None)
            yield Batch(b, e, negs, nodes, links)

    @staticmethod
    def predict_classes(logits: DataFrame) -> DataFrame:
        """(id, y_pred, y_true) of (id, y_true, logits)."""
        return logits.select("id", argmax(F.col("logits")).alias("y_pred"), "y_true")

    @staticmethod
    def report(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
        return results.agg(F.count(F.lit(1)).alias("n"), *[scoring.metric(m).alias(m.lower()) for m in metrics])

    def encode(self, vectors: DataFrame, layers: Sequence) -> DataFrame:
        """Fold layers over all nodes with whole neighbourhoods."""
        pairs = gnn.neighbour_pairs(self.edges)
        return gnn.encode(vectors, layers, lambda _: pairs)
