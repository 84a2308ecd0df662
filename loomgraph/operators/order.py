"""Positions in a global order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.hashing import digest

#: buckets for each shuffle partition of the session: enough to even out, few enough to rank globally
BUCKETS = 16


def bucket_digits(df: DataFrame) -> int:
    """Leading hex digits of the digest that make a bucket: 3 (4,096 buckets) or more, as the session has partitions."""
    buckets, digits = BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3
    while 16**digits < buckets:
        digits += 1
    return digits


def hash_positions(df: DataFrame, seed: int | str, keys: list[str], name: str = "pos", major: Column | None = None, digits: int | None = None, total: str | None = None) -> DataFrame:
    """Append `name`: the place, from 0, of each row ordered by `major`, then by the digest of seed and keys, then by keys.

    Rows are numbered within buckets of equal leading digits; the bucket sizes, a bounded table, give the offsets. The
    result doesn't depend on the number of digits.
    `major` must be a small integer (null: 0). `total` names a further column for the number of all rows.
    """
    digits = digits or bucket_digits(df)
    d = df.withColumn("_digest", digest(seed, *keys)).withColumn("_major", F.coalesce(major.cast("int"), F.lit(0)) if major is not None else F.lit(0))
    d = d.withColumn("_bucket", F.substring("_digest", 1, digits))
    sizes = d.groupBy("_major", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_major", "_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("_major", "_bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counted = [F.sum("_n").over(whole).alias(total)] if total else []
    offsets = F.broadcast(sizes.select("_major", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), *counted))  # at most majors x 16 ** digits rows
    within = W.partitionBy("_major", "_bucket").orderBy("_digest", *keys)
    placed = d.withColumn("_rn", F.row_number().over(within)).join(offsets, ["_major", "_bucket"])
    return placed.withColumn(name, (F.col("_offset") + F.col("_rn") - 1).cast("bigint")).drop("_digest", "_major", "_bucket", "_rn", "_offset")


def with_batches(df: DataFrame, batch_size: int, pos: str = "pos", name: str = "batch_id") -> DataFrame:
    """Append the batch of each position; the last batch may be short."""
    return df.withColumn(name, F.floor(F.col(pos) / F.lit(batch_size)).cast("bigint"))


def with_chunks(df: DataFrame, n_chunks: int, total: int, pos: str = "pos", name: str = "chunk_id") -> DataFrame:
    """Append the chunk of each position: chunks of ceil(total / n_chunks) rows."""
    return df.withColumn(name, F.floor(F.col(pos) / F.lit(-(-total // n_chunks) or 1)).cast("bigint"))


def exclusive_sums(df: DataFrame, order: list[str], value: str, name: str = "offset_before") -> DataFrame:
    """Append the sum of `value` over all rows before, of a small table (buckets, partitions)."""
    return df.withColumn(name, F.coalesce(F.sum(value).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
