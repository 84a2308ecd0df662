"""Degrees and orphan state kept up to date over streams of edges and parent events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators import ingest, orphans
from loomgraph.sources.sinks import forget_before, latest_state, save_state


def merged(path: str, step: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that turns the last version under `path` and a batch into the next; a repeated batch is skipped."""

    def run(batch: DataFrame, epoch: int) -> None:
        last = latest_state(batch.sparkSession, path)
        if last is None or last[0] < epoch:
            save_state(step(None if last is None else last[1], batch), path, epoch)
            if last is not None:
                forget_before(batch.sparkSession, path, last[0])  # the one before stays, for readers that are at it

    return run


def _add_degrees(state: DataFrame | None, edges: DataFrame) -> DataFrame:
    new = ingest.degrees(edges)
    if state is None:
        return new
    return new.unionByName(state).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("out_degree", "in_degree", "degree")])


def _add_orphans(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    refs = batch.filter("kind = 'reference'").select("parent", "label")
    events = batch.filter("kind = 'parent'").select("parent", "label", "delta")
    return orphans.advance(state, refs, events)


def _start(stream: DataFrame, path: str, step: Callable) -> StreamingQuery:
    return stream.writeStream.foreachBatch(merged(f"{path}/state", step)).option("checkpointLocation", f"{path}/progress").start()


def degrees_of_stream(edges: DataFrame, path: str) -> StreamingQuery:
    """Keep degrees of an append-only stream of edges (src, dst) in versions under path."""
    return _start(edges, path, _add_degrees)


def orphans_of_stream(events: DataFrame, path: str) -> StreamingQuery:
    """Keep orphan state over a stream of (kind, parent, label, delta): references, and parents that come (+1) or go (-1)."""
    return _start(events, path, _add_orphans)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    last = latest_state(spark, f"{path}/state")
    return None if last is None else last[1]
