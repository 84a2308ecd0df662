"""Edge decoders, negatives' scores, ranks, metrics and losses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import vectors as V
from loomgraph.session import BROADCAST_BYTES, sent_if_small, written

MASKED = -1e9  # fixed value: score of a negative that is a known edge
#: a node table beyond BROADCAST_BYTES is visited in blocks of so many nodes, a large relation table likewise
BLOCK_NODES, BLOCK_RELS = 65_536, 1024
#: steps that the scores of known edges are divided into, so that those of a hub are ordered in as many tasks
STEPS = 1024
#: bytes of a row with a vector, for the decision what to send to every worker
VECTOR_ROW = 1024

#: relation operator and comparator by decoder; TransE's distance is negated, so a larger score is a better one
DECODERS = {
    "distmult": lambda s, r, d: V.dot(V.hadamard(s, r), d),
    "complex": lambda s, r, d: V.dot(V.complex_product(s, r), d),
    "transe": lambda s, r, d: -V.l2(V.translate(s, r), d),
    "cosine": lambda s, r, d: V.cosine(s, d),
    "l2": lambda s, r, d: V.l2(s, d),
}


def gathered(edges: DataFrame, nodes: DataFrame, rels: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Append the vectors vs, vr and vd of edges; nodes (id, vec), rels (rel, vec)."""
    side = lambda c, v: nodes.select(F.col("id").alias(c), F.col("vec").alias(v))
    return edges.join(side(src, "vs"), src).join(side(dst, "vd"), dst).join(rels.select("rel", F.col("vec").alias("vr")), "rel")


def edge_scores(edges: DataFrame, nodes: DataFrame, rels: DataFrame, decoder: str) -> DataFrame:
    """Append score to edges."""
    out = gathered(edges, nodes, rels)
    return out.withColumn("score", DECODERS[decoder](F.col("vs"), F.col("vr"), F.col("vd"))).drop("vs", "vr", "vd")


def inverse_scores(edges: DataFrame, nodes: DataFrame, inverse_rels: DataFrame, decoder: str) -> DataFrame:
    """Append score of the inverse edges, from dst to src under the inverse relation."""
    return swapped(edge_scores(swapped(edges), nodes, inverse_rels, decoder))


def swapped(edges: DataFrame) -> DataFrame:
    """Edges the other way round."""
    return edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])


def chunk_scores(chunked: DataFrame, negatives: DataFrame, nodes: DataFrame, rels: DataFrame, decoder: str) -> DataFrame:
    """(edge_id, neg_id, node, score): each edge against the negatives of its chunk as dst.

    Chunks are few, so edges aren't shuffled by them: the negatives go to every worker if they are no more than that allows.
    """
    each = gathered(chunked, nodes, rels).select("edge_id", "chunk_id", "vs", "vr")
    negs = negatives.join(nodes.select(F.col("id").alias("node"), F.col("vec").alias("vn")), "node").select("chunk_id", "neg_id", "node", "vn")
    return each.join(sent_if_small(negs, VECTOR_ROW, negatives), "chunk_id").select("edge_id", "neg_id", "node", DECODERS[decoder](F.col("vs"), F.col("vr"), F.col("vn")).alias("score"))


def chunk_rows(chunked: DataFrame, negatives: DataFrame, nodes: DataFrame, rels: DataFrame, decoder: str, dim: int) -> DataFrame:
    """(edge_id, score, negs): each edge in one row with the scores of its chunk's negatives as dst, in order of neg_id.

    The other side is had with swapped() edges and inverse relations. Scores are matrix products of a batch with the
    negatives of a chunk, which go to every worker if they are few enough, and else to the chunk's edges.
    """
    each = gathered(chunked, nodes, rels).select("edge_id", "chunk_id", "vs", "vr", "vd")
    negs = negatives.join(nodes.select(F.col("id").alias("node"), F.col("vec").alias("vn")), "node").select("chunk_id", "neg_id", "vn")
    if negatives.count() * VECTOR_ROW <= BROADCAST_BYTES:
        found = negs.orderBy("chunk_id", "neg_id").toArrow().combine_chunks()
        chunk = np.asarray(found["chunk_id"])
        matrices = {int(c): _rows(pc.list_flatten(found["vn"].filter(pa.array(chunk == c))).combine_chunks(), dim, flat=True) for c in np.unique(chunk)}
        shared = chunked.sparkSession.sparkContext.broadcast(matrices)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                chunks = np.asarray(b.column("chunk_id"))
                for c in np.unique(chunks):
                    part = b.filter(pa.array(chunks == c))
                    s, r, d = (_rows(part.column(k), dim) for k in ("vs", "vr", "vd"))
                    lists = _np_scores(decoder, s, r, shared.value.get(int(c), np.zeros((0, dim))))
                    ends = pa.array(np.arange(len(s) + 1) * lists.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column("edge_id"), pa.array(_np_pairs(decoder, s, r, d)), pa.ListArray.from_arrays(ends, pa.array(lists.ravel()))], names=["edge_id", "score", "negs"])

        return each.mapInArrow(scored, "edge_id bigint, score double, negs array<double>")
    lists = negs.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("neg_id", "vn"))).alias("vns"))  # as many as a chunk has negatives
    score = DECODERS[decoder]
    return each.join(lists, "chunk_id", "left").select(
        "edge_id", score(F.col("vs"), F.col("vr"), F.col("vd")).alias("score"), F.transform(F.coalesce("vns", F.array().cast("array<struct<neg_id:bigint,vn:array<double>>>")), lambda x: score(F.col("vs"), F.col("vr"), x["vn"])).alias("negs")
    )


def relation_scores(edges: DataFrame, nodes: DataFrame, rels: DataFrame, decoder: str) -> DataFrame:
    """(edge_id, rel, score): each edge under every relation. A small relation table goes to every worker as one array; of a larger one each edge visits all blocks."""
    side = lambda c, v: nodes.select(F.col("id").alias(c), F.col("vec").alias(v))
    both = edges.drop("rel").join(side("src", "vs"), "src").join(side("dst", "vd"), "dst").select("edge_id", "vs", "vd")
    n = rels.count()
    blocks = 1 if n * VECTOR_ROW <= BROADCAST_BYTES else -(-n // BLOCK_RELS)
    by_block = rels.groupBy(F.pmod(F.xxhash64("rel"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("rel", "vec")).alias("rels"))
    if blocks == 1:
        visits = both.join(F.broadcast(by_block))
    else:
        visits = both.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(by_block, "block")
    return visits.select("edge_id", "vs", "vd", F.explode("rels").alias("r")).select("edge_id", "r.rel", DECODERS[decoder](F.col("vs"), F.col("r.vec"), F.col("vd")).alias("score"))


def masked(scores: DataFrame, matches: DataFrame) -> DataFrame:
    """Scores with those of (edge_id, neg_id) in matches overwritten."""
    known = scores.join(matches.select("edge_id", "neg_id").distinct().withColumn("_known", F.lit(True)), ["edge_id", "neg_id"], "left")
    return known.withColumn("score", F.when(F.col("_known"), F.lit(MASKED)).otherwise(F.col("score"))).drop("_known")


def ranks(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(edge_id, rank): 1 + the negatives that score at least as well; ties count against the edge. Scores are compared to 9 decimals."""
    beat = negatives.select("edge_id", F.round("score", 9).alias("n")).join(positives.select("edge_id", F.round("score", 9).alias("p")), "edge_id").filter("n >= p")
    counts = beat.groupBy("edge_id").agg(F.count(F.lit(1)).alias("k"))
    return positives.select("edge_id").join(counts, "edge_id", "left").select("edge_id", (F.coalesce("k", F.lit(0)) + 1).alias("rank"))


def _np_scores(decoder: str, s: np.ndarray, r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Scores of queries (rows of s and r) against all rows of n."""
    if decoder in ("distmult", "complex"):
        return query_vectors(decoder, s, r) @ n.T
    if decoder == "transe":
        q = query_vectors(decoder, s, r)
        return -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (n * n).sum(1)[None] - 2 * q @ n.T, V.NORM_FLOOR))
    if decoder == "cosine":
        return (s @ n.T) / np.maximum(np.linalg.norm(s, axis=1)[:, None] * np.linalg.norm(n, axis=1)[None], 1e-300)
    raise ValueError(f"no such decoder: {decoder}")


def _np_pairs(decoder: str, s: np.ndarray, r: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The score of each row of s and r with its row of d."""
    return np.array([_np_scores(decoder, s[i : i + 1], r[i : i + 1], d[i : i + 1])[0, 0] for i in range(len(s))]) if decoder == "transe" else _np_dots(decoder, s, r, d)


def _np_dots(decoder: str, s: np.ndarray, r: np.ndarray, d: np.ndarray) -> np.ndarray:
    if decoder == "cosine":
        return (s * d).sum(1) / np.maximum(np.linalg.norm(s, axis=1) * np.linalg.norm(d, axis=1), 1e-300)
    return (query_vectors(decoder, s, r) * d).sum(1)


def query_vectors(decoder: str, s: np.ndarray, r: np.ndarray) -> np.ndarray:
    """What is compared with dst by a dot product (distmult, complex) or by distance (transe)."""
    if decoder == "distmult":
        return s * r
    if decoder == "complex":
        h = s.shape[1] // 2
        return np.concatenate([s[:, :h] * r[:, :h] - s[:, h:] * r[:, h:], s[:, :h] * r[:, h:] + s[:, h:] * r[:, :h]], 1)
    if decoder == "transe":
        return s + r
    raise ValueError(f"no such decoder: {decoder}")


def _rows(column: pa.Array, dim: int, flat: bool = False) -> np.ndarray:
    return np.asarray(column if flat else column.flatten(), dtype=np.float64).reshape(-1, dim)


def beaten_by_all(queries: DataFrame, nodes: DataFrame, decoder: str, dim: int) -> DataFrame:
    """(edge_id, n_beat): how many of all nodes score at least as well as dst, itself included.

    queries (edge_id, vs, vr, score). No pair is ever a row: scores are computed block by block with matrix products
    and only counted. A node table within BROADCAST_BYTES goes to all workers; of a larger one, each query visits the
    blocks of BLOCK_NODES nodes.
    """
    n = nodes.count()
    spark = queries.sparkSession

    def count(q: pa.Table | pa.RecordBatch, matrix: np.ndarray) -> np.ndarray:
        s, r, p = _rows(q["vs"].combine_chunks() if isinstance(q, pa.Table) else q.column("vs"), dim), _rows(q["vr"].combine_chunks() if isinstance(q, pa.Table) else q.column("vr"), dim), np.round(np.asarray(q["score"]), 9)
        return (np.round(_np_scores(decoder, s, r, matrix), 9) >= p[:, None]).sum(1)

    if n * dim * 8 <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast(_rows(pc.list_flatten(nodes.select("vec").toArrow()["vec"]).combine_chunks(), dim, flat=True))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    yield pa.RecordBatch.from_arrays([part.column("edge_id"), pa.array(count(part, shared.value))], names=["edge_id", "n_beat"])

        return queries.select("edge_id", "vs", "vr", "score").mapInArrow(whole, "edge_id bigint, n_beat bigint")
    blocks = -(-n // BLOCK_NODES)
    placed = nodes.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "vec")
    salts = max(1, queries.count() // 20_000)
    visits = queries.select("edge_id", "vs", "vr", "score", F.pmod(F.xxhash64("edge_id"), F.lit(salts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    copies = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def block(q: pa.Table, m: pa.Table) -> pa.Table:
        beat = count(q, _rows(m["vec"].combine_chunks(), dim)) if q.num_rows and m.num_rows else np.zeros(q.num_rows, np.int64)
        return pa.table({"edge_id": q["edge_id"], "n_beat": pa.array(beat.astype(np.int64))})

    counted = visits.groupBy("part", "block").cogroup(copies.groupBy("part", "block")).applyInArrow(block, "edge_id bigint, n_beat bigint")
    return counted.groupBy("edge_id").agg(F.sum("n_beat").alias("n_beat"))


def all_node_ranks(edges: DataFrame, nodes: DataFrame, rels: DataFrame, decoder: str, dim: int, known: DataFrame | None = None) -> DataFrame:
    """(edge_id, rank) of edges against all nodes as dst.

    Unfiltered, the edge itself is one of its negatives, so its rank is 2 at best. With `known` edges (src, rel, dst)
    all of those are left out of the negatives: they are scored one by one, counted and subtracted.
    """
    g = gathered(edges, nodes, rels)
    q = g.select("edge_id", "vs", "vr", DECODERS[decoder](F.col("vs"), F.col("vr"), F.col("vd")).alias("score"))
    beat = beaten_by_all(q, nodes, decoder, dim)
    if known is None:
        return beat.select("edge_id", (F.col("n_beat") + 1).alias("rank"))
    pos = edge_scores(edges, nodes, rels, decoder).select("edge_id", "src", "rel", F.round("score", 9).alias("score"))
    others = edge_scores(known.select("src", "rel", "dst").distinct(), nodes, rels, decoder).select("src", "rel", F.round("score", 9).alias("score"))
    drop = known_at_least(pos, others)
    return beat.join(drop, "edge_id", "left").select("edge_id", (F.col("n_beat") - F.coalesce("n_known", F.lit(0)) + 1).alias("rank"))


def known_at_least(positives: DataFrame, known: DataFrame) -> DataFrame:
    """(edge_id, n_known) of positives (edge_id, src, rel, score): the known (src, rel, score) of equal src and rel that score at least as well.

    No pair is a row: both are put in order together and counted. The order is taken step by step of the score, with the
    steps' counts as offsets, so the edges of a hub are in as many tasks as its scores have steps.
    """
    none = F.lit(None).cast("bigint")
    both = written(positives.select("edge_id", "src", "rel", "score", F.lit(0).alias("n")).unionByName(known.select(none.alias("edge_id"), "src", "rel", "score", F.lit(1).alias("n"))), "ordered")
    lo, hi = both.agg(F.min("score"), F.max("score")).first()
    width = max((hi or 0.0) - (lo or 0.0), 1e-9) / STEPS
    stepped = both.withColumn("step", F.floor((F.col("score") - (lo or 0.0)) / width))
    counts = stepped.groupBy("src", "rel", "step").agg(F.sum("n").alias("n"))
    above = W.partitionBy("src", "rel").orderBy(F.col("step").desc()).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("src", "rel", "step", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    within = W.partitionBy("src", "rel", "step").orderBy(F.col("score").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    placed = stepped.withColumn("within", F.sum("n").over(within)).filter(F.col("edge_id").isNotNull())
    return placed.join(offsets, ["src", "rel", "step"]).select("edge_id", (F.col("above") + F.col("within")).alias("n_known"))


def both_side_ranks(edges: DataFrame, nodes: DataFrame, rels: DataFrame, inverse_rels: DataFrame, decoder: str, dim: int, known: DataFrame | None = None) -> DataFrame:
    """(edge_id, side, rank): two ranks an edge, against all nodes as dst, and as src under the inverse relations."""
    dst = all_node_ranks(edges, nodes, rels, decoder, dim, known)
    src = all_node_ranks(swapped(edges), nodes, inverse_rels, decoder, dim, None if known is None else swapped(known))
    return dst.select("edge_id", F.lit("dst").alias("side"), "rank").unionByName(src.select("edge_id", F.lit("src").alias("side"), "rank"))


def mrr(r: str = "rank") -> Column:
    return F.avg(1.0 / F.col(r))


def mean_rank(r: str = "rank") -> Column:
    return F.avg(F.col(r).cast("double"))


def hits(k: int, r: str = "rank") -> Column:
    return F.avg((F.col(r) <= k).cast("double"))


def accuracy(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    return 100 * F.avg((F.col(y_true) == F.col(y_pred)).cast("double"))


def metric(name: str) -> Column:
    """By name, in any case: MRR, MR, HITS@k, ACC and their long forms."""
    n = name.upper().replace("_", "").replace(" ", "")
    if n in ("MRR", "MEANRECIPROCALRANK"):
        return mrr()
    if n in ("MR", "MEANRANK"):
        return mean_rank()
    if n.startswith("HITS") and n[4:].lstrip("@K").isdigit():
        return hits(int(n[4:].lstrip("@K")))
    if n in ("ACC", "ACCURACY", "CATEGORICALACCURACY"):
        return accuracy()
    raise ValueError(f"no such metric: {name}")


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def pointwise_loss(kind: str, score: Column, y: Column) -> Column:
    """bce_sigmoid and bce_logits: binary cross entropy of the sigmoid of the score; mse: of the score itself; softplus."""
    if kind in ("bce_sigmoid", "bce_logits"):
        return _softplus(score) - score * y
    if kind == "mse":
        return (score - y) * (score - y)
    if kind == "softplus":
        return _softplus(-(2 * y - 1) * score)
    raise ValueError(f"no such loss: {kind}")


def chunk_ranks(scored: DataFrame) -> DataFrame:
    """(edge_id, rank) of chunk_rows: 1 + the negatives that score at least as well, to 9 decimals."""
    p = F.round("score", 9)
    return scored.select("edge_id", (1 + F.size(F.filter("negs", lambda n: F.round(n, 9) >= p))).cast("bigint").alias("rank"))


def link_loss(kind: str, scored: DataFrame, margin: float = 0.1) -> DataFrame:
    """One row (loss_sum, loss_mean) of chunk_rows (edge_id, score, negs), in one pass.

    softmax_ce and cross_entropy: of the edge among itself and its negatives. ranking: over all pairs. Others: over all
    scores, with target 1 for edges and 0 for negatives. Without rows the sum and the mean are null.
    """
    p, total = F.col("score"), lambda f: F.aggregate(F.transform("negs", f), F.lit(0.0), lambda a, x: a + x)
    if kind in ("softmax_ce", "cross_entropy"):
        m = F.greatest(p, F.coalesce(F.array_max("negs"), p))
        x, n = m + F.log(F.exp(p - m) + total(lambda s: F.exp(s - m))) - p, F.lit(1)
    elif kind == "ranking":
        x, n = total(lambda s: F.greatest(s - p + margin, F.lit(0.0))), F.size("negs")
    else:
        x, n = pointwise_loss(kind, p, F.lit(1.0)) + total(lambda s: pointwise_loss(kind, s, F.lit(0.0))), F.size("negs") + 1
    each = scored.select(x.alias("x"), n.alias("n"))
    return each.agg(F.sum("x").alias("loss_sum"), F.try_divide(F.sum("x"), F.sum("n")).alias("loss_mean"))


def class_loss(logits: DataFrame) -> DataFrame:
    """One row (loss_sum, loss_mean): cross entropy of logits (array) against y_true."""
    m = F.array_max("logits")
    lse = m + F.log(F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - m)))
    each = logits.select((lse - F.col("logits")[F.col("y_true")]).alias("x"))
    return each.agg(F.sum("x").alias("loss_sum"), F.avg("x").alias("loss_mean"))


def norm_penalty(edges: DataFrame, nodes: DataFrame, p: int, coef: float, dim: int) -> DataFrame:
    """One row (penalty): coef / 2 times the sum over components of the p-norms of all src and of all dst vectors."""
    parts = []
    for end in ("src", "dst"):
        v = edges.join(nodes.select(F.col("id").alias(end), "vec"), end)
        sums = v.agg(*[F.pow(F.sum(F.pow(F.abs(F.col("vec")[i]), p)), 1.0 / p).alias(f"s{i}") for i in range(dim)])
        parts.append(sums.select(sum(F.col(f"s{i}") for i in range(dim)).alias("x")))
    return parts[0].unionByName(parts[1]).agg((F.sum("x") * coef / 2).alias("penalty"))
