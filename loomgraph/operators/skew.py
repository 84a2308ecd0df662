"""Per-key results where a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.labels import normal_form
from loomgraph.session import only

#: sub-keys of a heavy label at least, and rows of the table for each of them beyond that
SALTS, ROWS_PER_SALT = 64, 1_000_000
HEAVY_SHARE = 0.005


def heavy_labels(df: DataFrame, columns: tuple[str, ...], share: float = HEAVY_SHARE) -> DataFrame:
    """(field, term) of labels that stand in at least `share` of the rows in one of `columns`.

    At most len(columns) / share rows, whatever the size of df. Raw spellings are counted first, with map-side
    combine, so only distinct spellings are normalised.
    """
    n = df.count()
    raw = only(df, *columns).select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in columns])).alias("x")).select("x.*")
    counted = raw.groupBy("field", "raw").agg(F.count(F.lit(1)).alias("n"))
    terms = counted.select("field", normal_form(F.col("raw")).alias("term"), "n").groupBy("field", "term").agg(F.sum("n").alias("n"))
    return terms.filter(F.col("term").isNotNull() & (F.col("n") >= F.lit(share * max(n, 1)))).select("field", "term")


def label_stats(
    edges: DataFrame,
    src: str = "src_column",
    dst: str = "dst_column",
    weight: str = "edge_weight_column",
    salts: int | None = None,
    share: float = HEAVY_SHARE,
) -> DataFrame:
    """(field, term, n_edges, n_neighbours, sum_weight) for every label in `src` and in `dst`.

    Heavy labels get a salt drawn from the hash of the neighbour, of as many as the table's rows call for; light ones salt 0. Stage one gives partials per
    (label, salt), stage two merges them per label. As equal neighbours of a label share their salt, the distinct
    counts of the partials add up. Rows are combined on the map side before each exchange, also exact copies.

    Absent labels (null, or an empty normal form) are no terms; an absent neighbour counts as an edge but not as a
    neighbour; null weights add nothing, and a label without any weight has a null sum. An empty table gives no rows.
    Other columns of `edges` are not read, whatever their names.
    """
    ends = only(edges, src, dst, weight).select(normal_form(F.col(src)).alias("s"), normal_form(F.col(dst)).alias("d"), F.col(weight).cast("double").alias("w"))
    both = ends.select(
        F.explode(
            F.array(
                F.struct(F.lit(src).alias("field"), F.col("s").alias("term"), F.col("d").alias("neighbour"), "w"),
                F.struct(F.lit(dst).alias("field"), F.col("d").alias("term"), F.col("s").alias("neighbour"), "w"),
            )
        ).alias("x")
    ).select("x.*")
    salts = salts or max(SALTS, -(-edges.count() // ROWS_PER_SALT))
    # bounded by 2 / share rows, see heavy_labels
    heavy = F.broadcast(heavy_labels(edges, (src, dst), share).withColumn("heavy", F.lit(True)))
    salted = (
        both.filter(F.col("term").isNotNull())
        .join(heavy, ["field", "term"], "left")
        .withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("neighbour"), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    )
    pairs = salted.groupBy("field", "term", "salt", "neighbour").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    partial = pairs.groupBy("field", "term", "salt").agg(F.sum("n").alias("n"), F.count("neighbour").alias("d"), F.sum("w").alias("w"))
    return partial.groupBy("field", "term").agg(
        F.sum("n").alias("n_edges"), F.sum("d").alias("n_neighbours"), F.round(F.sum("w"), 4).alias("sum_weight")
    )


def dominant_labels(stats: DataFrame, n_rows: int, share: float = 0.02) -> DataFrame:
    """Of the result of label_stats, the labels that stand in at least `share` of `n_rows` rows."""
    return stats.filter(F.col("n_edges") >= F.lit(share) * F.lit(n_rows)).select("field", "term")
