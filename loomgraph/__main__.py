"""Command line: python -m loomgraph generate|prepare|train|evaluate|export|stats CONFIG.json"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph import config as C
from loomgraph.graph import Graph
from loomgraph.operators import optim, scoring, train
from loomgraph.sources import delimited, sinks


def prepare(spark: SparkSession, c: C.Config) -> None:
    """Read, encode and split edges; write edges and dictionaries."""
    s = c.source
    raw = delimited.read_delimited(spark, list(s.paths), s.columns, s.delim, s.header_length)
    raw = raw if "rel" in raw.columns else raw.withColumn("rel", F.lit("0"))
    # equal edges are one: nothing tells them apart
    edges = raw.select("src", "rel", "dst").na.drop().distinct().withColumn("edge_id", F.concat_ws("\x01", "src", "rel", "dst"))
    g = Graph.prepare(edges, s.fractions, c.settings.seed)
    for name, df in (("edges", g.edges.withColumn("edge_id", F.xxhash64("edge_id"))), ("nodes", g.nodes), ("rels", g.rels)):
        df.write.mode("overwrite").parquet(f"{c.out}/graph/{name}")


def graph(spark: SparkSession, c: C.Config) -> Graph:
    return Graph(*[spark.read.parquet(f"{c.out}/graph/{name}") for name in ("edges", "nodes", "rels")])


def fresh_model(spark: SparkSession, g: Graph, c: C.Config) -> train.Model:
    """Vectors drawn by hash within the limit for tables of this shape."""
    s = c.settings
    shapes = C.parameters(c, g.nodes.count(), g.rels.count())
    rels = g.rels.crossJoin(F.broadcast(spark.createDataFrame([("rel",), ("inverse",)], "kind string")))
    drawn = lambda df, seed: optim.initial_vectors(df, s.dim, optim.glorot_limit(*shapes["nodes"]), seed)
    parts = [drawn(rels.filter(F.col("kind") == k).select("id"), f"{s.seed}:{k}").withColumn("kind", F.lit(k)) for k in ("rel", "inverse")]
    return train.Model(drawn(g.nodes.select("id"), f"{s.seed}:nodes"), parts[0].unionByName(parts[1]))


def newest(spark: SparkSession, c: C.Config) -> train.Model:
    last = sinks.latest_state(spark, f"{c.out}/versions/nodes")
    if last is None:
        raise SystemExit("no trained version: run train first")
    return train.Model(last[1], spark.read.parquet(f"{c.out}/versions/rels/epoch={last[0]}"))


def run(spark: SparkSession, command: str, c: C.Config) -> None:
    if command == "prepare":
        return prepare(spark, c)
    g = graph(spark, c)
    if command == "stats":
        return g.stats().show(truncate=False)
    if command == "train":
        _, history = train.train(g.split("train"), fresh_model(spark, g, c), c.settings, c.epochs, f"{c.out}/versions", g.split("valid"))
        return print(*history, sep="\n")
    model, s = newest(spark, c), c.settings
    if command == "evaluate":
        ranks = g.evaluate(model.node_vectors, model.rel_vectors(), model.rel_vectors("inverse"), s.decoder, s.dim)
        sinks.write_metrics(ranks, {m: scoring.metric(m) for m in c.metrics}, f"{c.out}/metrics")
        return spark.read.option("header", True).csv(f"{c.out}/metrics").show()
    sinks.export_embeddings(model.node_vectors, g.nodes, f"{c.out}/vectors", overwrite=True)
    sinks.export_model(model.nodes, model.rels, f"{c.out}/model", overwrite=True)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    p.add_argument("command", choices=("generate", "prepare", "train", "evaluate", "export", "stats"))
    p.add_argument("config", help="a JSON file; for generate, the one to write")
    p.add_argument("--paths", nargs="*", default=[], help="for generate: edge files")
    p.add_argument("--out", default="", help="for generate: the folder of results")
    a = p.parse_args(args)
    if a.command == "generate":
        with open(a.config, "w", encoding="utf-8") as f:
            f.write(C.dump(C.generated(a.paths, a.out)))
        return
    run(SparkSession.builder.getOrCreate(), a.command, C.load(a.config))


if __name__ == "__main__":
    main(sys.argv[1:])
