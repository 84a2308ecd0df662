"""Same or near-same edges across splits: a weighted cosine join over inverted lists.

An edge gives a vector for each of its endpoints: that endpoint (the anchor) is held fixed, and the terms are the pieces
of the other one, crossed with edge type and anchor, so a hub's list holds only edges that share a piece as well. A long
label has three pieces: its last PIECE characters, the PIECE before them, and the head. The rarer a piece in all edges,
the greater its weight.

Of two labels that differ by one edit at most one piece differs. So a true pair's dot product is at least the squared
norm of the train vector less its greatest squared weight (the bound). Hence
* residual norm: a train vector needs to be listed under its two heaviest terms only, as what is left is below the bound;
* the other side probes with heads only where they outweigh another of its pieces;
* maximum weight: lists whose greatest weight in the other split is zero are dropped before anything is shuffled;
* what shares a list is kept if its exact dot product reaches the bound, and is then compared by edits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.labels import normal_form
from loomgraph.session import only, sent_if_small, spread, written

#: characters of a label's last two pieces; labels of at most SHORT characters use deletion variants, both from LONG on
PIECE = 5
LONG, SHORT = 2 * PIECE, 2 * PIECE + 1
TRAIN, EVAL = "train", ("valid", "test")
#: counters that pieces are counted in; bits of the filter of probed terms for each row outside train, and at most
COUNTERS = 1 << 16
FILTER_BITS, MOST_FILTER_BITS = 64, 1 << 28
#: rows of a list, or copies of an edge, that are joined in one slice
SLICE = 20_000


def normal_edges(edges: DataFrame) -> DataFrame:
    """(edge_id, split, source, kind, lo, hi, key): endpoints in order, absent labels left out; key hashes kind, lo and hi."""
    named = spread(only(edges, "edge_id", "split", "source", "src_column", "edge_type_column", "dst_column"))
    n = named.filter(F.col("split").isin(TRAIN, *EVAL) & F.col("edge_id").isNotNull()).select(
        "edge_id", "split", "source", normal_form(F.col("edge_type_column")).alias("kind"), normal_form(F.col("src_column")).alias("s"), normal_form(F.col("dst_column")).alias("d")
    )
    both = n.filter(F.col("kind").isNotNull() & F.col("s").isNotNull() & F.col("d").isNotNull())
    return both.select("edge_id", "split", "source", "kind", F.least("s", "d").alias("lo"), F.greatest("s", "d").alias("hi")).withColumn("key", F.xxhash64("kind", "lo", "hi"))


def _vectors(edges: DataFrame, *kept: str) -> DataFrame:
    """(*kept, kind, anchor, other): an edge once for each of its endpoints."""
    way = lambda a, o: F.struct(F.col(a).alias("anchor"), F.col(o).alias("other"))
    ways = F.when(F.col("lo") == F.col("hi"), F.array(way("lo", "hi"))).otherwise(F.array(way("lo", "hi"), way("hi", "lo")))
    return edges.select(*kept, "kind", F.explode(ways).alias("v")).select(*kept, "kind", "v.anchor", "v.other")


def _piece(role: str, label: Column, shift: int = 0) -> Column:
    """A piece of a label, as the label cuts it, or as one that is `shift` characters longer would."""
    n = F.length(label) + shift
    if role == "head":
        return F.substring(label, F.lit(1), n - 2 * PIECE)
    return F.substring(label, n - 2 * PIECE + 1, F.lit(PIECE)) if role == "middle" else F.substring(label, -PIECE, PIECE)


def _counter(role: str, piece: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(role), piece), F.lit(COUNTERS)).cast("int")


def piece_weights(edges: DataFrame) -> DataFrame:
    """One row (weights): the squared weight of a piece by its counter, from the number of such pieces in all edges.

    Pieces are counted in a fixed number of counters; pieces that share one share their weight, which changes what is
    pruned but no result.
    """
    label = F.col("label")
    labels = edges.select(F.explode(F.array("lo", "hi")).alias("label")).filter(F.length("label") >= LONG)
    counted = labels.select(F.explode(F.array(*[_counter(r, _piece(r, label)) for r in ("head", "middle", "tail")])).alias("c")).groupBy("c").count()
    found = counted.toArrow()
    n = np.zeros(COUNTERS)
    n[np.asarray(found["c"])] = np.asarray(found["count"])
    weights = np.log1p(max(n.sum(), 1) / np.maximum(n, 1))
    return edges.sparkSession.createDataFrame(pa.table({"weights": pa.array([weights], pa.list_(pa.float64()))}))


def _weight(role: str, piece: Column) -> Column:
    return F.col("weights")[_counter(role, piece)]


def _term(role: str, piece: Column) -> Column:
    return F.xxhash64(F.col("kind"), F.col("anchor"), F.lit(role), piece)


def _with_cuts(terms: list[Column]) -> Column:
    """The terms that aren't null, and of a short label those of itself and of it without each one of its characters: two labels within one edit share such a variant."""
    o, n = F.col("other"), F.length("other")
    without = lambda i: F.concat(F.substring(o, F.lit(1), F.greatest(i - 1, F.lit(0))), F.when(i > 0, F.substring(o, i + 1, n)).otherwise(o))
    cuts = F.when(n <= SHORT, F.transform(F.sequence(F.lit(0), n), lambda i: _term("cut", without(i)))).otherwise(F.array().cast("array<bigint>"))
    return F.explode(F.concat(F.array_compact(F.array(*terms)), cuts)).alias("term")


def _listed(vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """Train vectors by the terms that they are listed under: of the pieces of a long label all but the lightest."""
    o = F.col("other")
    head, middle, tail = (_piece(r, o) for r in ("head", "middle", "tail"))
    a, b, c = (F.col(f"w_{r}") for r in ("head", "middle", "tail"))
    weighed = vectors.join(F.broadcast(weights)).select("*", _weight("head", head).alias("w_head"), _weight("middle", middle).alias("w_middle"), _weight("tail", tail).alias("w_tail")).drop("weights")
    long = F.length(o) >= LONG
    least = F.when((a <= b) & (a <= c), F.lit(0)).when(b <= c, F.lit(1)).otherwise(F.lit(2))
    terms = [F.when(long & (least != i), _term(r, p)) for i, (r, p) in enumerate((("head", head), ("middle", middle), ("tail", tail)))]
    return weighed.select("edge_id", "key", "kind", "anchor", "other", _with_cuts(terms))


def _probing(vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, anchored, term) of vectors outside train.

    A train label may be one character longer or shorter, so heads and middles are cut for each length. A pair that
    shares a head shares another piece; if all of these outweigh the head, that one is among the two heaviest of the
    train vector.
    """
    o, n = F.col("other"), F.length("other")
    fits = {d: n + d >= LONG for d in (-1, 0, 1)}
    heads = {d: F.when(fits[d], _piece("head", o, d)) for d in fits}
    middles = {d: F.when(fits[d], _piece("middle", o, d)) for d in fits}
    tail = _piece("tail", o)
    most = F.greatest(*[_weight("head", heads[d]) for d in heads])
    least = F.least(_weight("tail", tail), *[_weight("middle", middles[d]) for d in middles])
    weighed = vectors.join(F.broadcast(weights)).select("key", "kind", "anchor", "other", (most > least).alias("with_heads"))
    long = n >= LONG
    terms = [
        *(F.when(long & fits[d] & F.col("with_heads"), _term("head", heads[d])) for d in heads),
        *(F.when(long & fits[d], _term("middle", middles[d])) for d in middles),
        F.when(long, _term("tail", tail)),
    ]
    return weighed.select("key", _with_cuts(terms))


def _positions(term: str, bits: int) -> tuple[Column, Column]:
    return F.col(term).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(F.col(term), 32).bitwiseAND(F.lit(bits - 1))


def _term_filter(terms: DataFrame, bits: int) -> DataFrame:
    """One row (bits): a Bloom filter of terms, of fixed size: what it lets pass in vain costs time but changes no result."""
    at = terms.select(F.explode(F.array(*_positions("term", bits))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[np.asarray(words["word"])] = np.asarray(words["mask"])
    return terms.sparkSession.createDataFrame(pa.table({"bits": pa.array([filled], pa.list_(pa.int64()))}))


def _probed(rows: DataFrame, passing: DataFrame, bits: int) -> DataFrame:
    """Rows whose term may be among those of the filter: all others have weight zero in the other split."""
    test = [F.expr(f"shiftrightunsigned(bits[cast(shiftright(p{k}, 6) as int)], cast(p{k} & 63 as int)) & 1L = 1L") for k in (0, 1)]
    p0, p1 = _positions("term", bits)
    return rows.select("*", p0.alias("p0"), p1.alias("p1")).join(F.broadcast(passing), test[0] & test[1], "left_semi").drop("p0", "p1")


def joined_in_slices(left: DataFrame, right: DataFrame, on: str, by: str) -> DataFrame:
    """Inner join; keys with more than SLICE rows on the right are joined slice by slice (as the hash of `by` has it), the left rows copied for each."""
    heavy = right.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("_slices")).filter("_slices > 1")
    heavy = sent_if_small(written(heavy, "heavy"), 32)  # at most a row for each SLICE
    sliced = right.join(heavy, on, "left").withColumn("_slice", F.pmod(F.xxhash64(by), F.coalesce("_slices", F.lit(1))).cast("int")).drop("_slices")
    copied = left.join(heavy, on, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))).drop("_slices")
    return copied.join(sliced, [on, "_slice"]).drop("_slice")


def _close(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Of (kind, anchor, other) and (kind_e, anchor_e, other_e), those that reach the bound and differ by one edit at most, with the cosine as `dot`."""
    o, y = F.col("other"), F.col("other_e")
    x = {r: _piece(r, o) for r in ("head", "middle", "tail")}
    # a middle holds its distance to the end, or to the start
    held = {
        "head": F.substring(y, F.lit(1), F.length(o) - 2 * PIECE) == x["head"],
        "middle": (_piece("middle", y) == x["middle"]) | (F.substring(y, F.length(o) - 2 * PIECE + 1, F.lit(PIECE)) == x["middle"]),
        "tail": _piece("tail", y) == x["tail"],
    }
    w = {r: _weight(r, x[r]) for r in x}
    long = (F.length(o) >= LONG) & (F.length(y) >= LONG)
    weighed = pairs.join(F.broadcast(weights)).select(
        "*", *[w[r].alias(f"w_{r}") for r in x], sum(F.when(held[r], w[r]).otherwise(F.lit(0.0)) for r in x).alias("d"), sum(_weight(r, _piece(r, y)) for r in x).alias("n_e")
    ).drop("weights")
    norm, top = F.col("w_head") + F.col("w_middle") + F.col("w_tail"), F.greatest("w_head", "w_middle", "w_tail")
    # a short label is a vector of its variants, each as heavy as any other: sharing one is enough
    enough = weighed.withColumn("dot", F.when(long, F.col("d") / F.sqrt(norm * F.col("n_e"))).when(o == y, F.lit(1.0))).filter(~long | (F.col("d") >= (norm - top) * (1 - 1e-9)))
    same = (F.col("kind") == F.col("kind_e")) & (F.col("anchor") == F.col("anchor_e"))
    return enough.filter(same & (F.levenshtein(o, y, 1) >= 0))


def overlaps(edges: DataFrame) -> DataFrame:
    """(edge_id_a, edge_id_b, edge_train, edge_eval, split, source, exact, dot) of every pair of a train and another edge.

    A pair has the same edge type and endpoints that agree, in this or the opposite direction, but for at most one
    inserted, deleted or replaced character in one of them; labels are compared in normal form. edge_id_a is the smaller
    id; split and source are those of the edge outside train; dot is the greater cosine of the two endpoints' vectors
    (null between short labels that differ). Edges with an absent label, without an id, or of another split, are in no
    pair. Every such pair is a row, also between copies. An empty table gives no rows.
    """
    e = normal_edges(edges)
    train, evals = e.filter(F.col("split") == TRAIN), e.filter(F.col("split") != TRAIN)
    weights = piece_weights(e)
    rows = only(edges, "split").filter(F.col("split").isin(*EVAL)).count()
    bits = min(MOST_FILTER_BITS, 1 << max(16, (FILTER_BITS * rows - 1).bit_length()))
    distinct = written(evals.select("key", "kind", "lo", "hi").distinct(), "evals")
    probing = _probing(_vectors(distinct, "key"), weights)
    listed = written(_probed(_listed(_vectors(train, "edge_id", "key"), weights), _term_filter(probing, bits), bits), "listed")
    lists = listed.select("term", F.col("key").alias("key_train"), "kind", "anchor", "other").distinct()
    shared = joined_in_slices(probing.select("term", F.col("key").alias("key_eval")), lists, "term", "key_train").drop("term").distinct()
    # the other edge's vector at the same anchor
    labels = distinct.select(F.col("key").alias("key_eval"), F.col("kind").alias("kind_e"), "lo", "hi")
    met = shared.join(labels, "key_eval").withColumn("anchor_e", F.when(F.col("anchor") == F.col("lo"), F.col("lo")).otherwise(F.col("hi"))).withColumn("other_e", F.when(F.col("anchor") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")))
    pairs = _close(met, weights).groupBy("key_train", "key_eval").agg(F.max(F.col("other") == F.col("other_e")).alias("exact"), F.max("dot").alias("dot"))
    of_eval = evals.select(F.col("key").alias("key_eval"), F.col("edge_id").alias("edge_eval"), "split", "source")
    of_train = listed.select(F.col("key").alias("key_train"), F.col("edge_id").alias("edge_train")).distinct()
    found = joined_in_slices(written(pairs, "pairs").join(of_eval, "key_eval"), of_train, "key_train", "edge_train")
    return found.select(F.least("edge_train", "edge_eval").alias("edge_id_a"), F.greatest("edge_train", "edge_eval").alias("edge_id_b"), "edge_train", "edge_eval", "split", "source", "exact", "dot")


def overlap_counts(pairs: DataFrame) -> DataFrame:
    """(split, source, n_edges, n_exact, n_pairs) of edges outside train with a partner in train; n_exact counts those with an equal one."""
    each = pairs.groupBy("split", "source", "edge_eval").agg(F.max(F.col("exact").cast("int")).alias("exact"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("exact").alias("n_exact"), F.sum("n").alias("n_pairs"))
