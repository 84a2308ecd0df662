"""Edges from delimited files, arrays, flat binary files and databases."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators.ingest import split_edges

COLUMNS = ("src_column", "edge_type_column", "dst_column", "edge_weight_column")
_NAMES = {"src_column": "src", "edge_type_column": "rel", "dst_column": "dst", "edge_weight_column": "weight"}


def read_delimited(spark: SparkSession, paths: str | Sequence[str], columns: dict[str, int | None], delim: str = "\t", header_length: int = 0) -> DataFrame:
    """(src[, rel], dst[, weight]) of the mapped positions, in this order; unmapped columns are not parsed out.

    Headers of one line are left to the CSV reader. Of longer ones, the first lines of each file are told by their
    byte offset: only lines within the first block of a file can be headers, so all other splits skip the test.
    """
    if columns.get("src_column") is None or columns.get("dst_column") is None:
        raise ValueError("src_column and dst_column must be mapped")
    taken = [(c, p) for c in COLUMNS if (p := columns.get(c)) is not None]
    width = max(p for _, p in taken) + 1
    paths = [paths] if isinstance(paths, str) else list(paths)
    if header_length <= 1:
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
        raw = spark.read.schema(schema).option("header", bool(header_length)).option("sep", delim).option("enforceSchema", True).csv(paths)
    else:
        lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        # the first block of a file is read by one task, in order
        numbered = lines.filter("start = 0").withColumn("seen", F.monotonically_increasing_id())
        first = numbered.groupBy("file").agg(F.min("seen").alias("first"))  # one row a file
        body = numbered.join(first, "file").filter(F.col("seen") >= F.col("first") + header_length).select("value").unionByName(lines.filter("start > 0").select("value"))
        # the same parser as for files, so quotes mean the same
        parsed = F.from_csv("value", ", ".join(f"_c{i} string" for i in range(width)), {"sep": delim})
        raw = body.select(parsed.alias("p")).select("p.*")
    kinds = {"edge_weight_column": "double"}
    return raw.select(*[F.col(f"_c{p}").cast(kinds.get(c, "string")).alias(_NAMES[c]) for c, p in taken])


def custom_dataset(spark: SparkSession, files: Sequence[str], columns: dict[str, int | None], delim: str = "\t", header_length: int = 0, fractions: Sequence[float] = (0.9, 0.05, 0.05), seed: int = 0) -> DataFrame:
    """Edges with a split: of one file by `fractions`, of two or three files one split a file (train, valid, test; train and test)."""
    if len(files) == 1:
        e = read_delimited(spark, files[0], columns, delim, header_length)
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in e.columns]
        return split_edges(e.withColumn("edge_id", F.concat_ws("\x01", *keys)), fractions, seed=seed).drop("edge_id")
    names = ("train", "valid", "test") if len(files) == 3 else ("train", "test")
    out = None
    for name, path in zip(names, files):
        part = read_delimited(spark, path, columns, delim, header_length).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def from_array(spark: SparkSession, edges: np.ndarray, weights: np.ndarray | None = None) -> DataFrame:
    """(src, rel, dst[, weight]) of an array with 2 or 3 columns; src is the first and dst the last."""
    import pandas as pd

    e = np.asarray(edges)
    frame = pd.DataFrame({"src": e[:, 0], "rel": e[:, 1] if e.shape[1] == 3 else np.zeros(len(e), e.dtype), "dst": e[:, -1]})
    if weights is not None:
        frame["weight"] = np.asarray(weights, dtype=np.float64)
    return spark.createDataFrame(frame)


def read_binary(spark: SparkSession, path: str, columns: Sequence[str], dtype: str = "int32") -> DataFrame:
    """Rows of a flat row-major file of one number type; the number of rows follows from its size. Files are split at record bounds."""
    kind = np.dtype(dtype).newbyteorder("<")
    width = len(columns)
    sql = {"i4": "int", "i8": "bigint", "f4": "float", "f8": "double"}[kind.str[1:]]
    records = spark.sparkContext.binaryRecords(path, kind.itemsize * width).map(lambda r: (bytearray(r),))
    types = {"i4": pa.int32(), "i8": pa.int64(), "f4": pa.float32(), "f8": pa.float64()}

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.frombuffer(b"".join(b.column(0).to_pylist()), kind).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(values[:, k]), types[kind.str[1:]]) for k in range(width)], names=list(columns))

    return spark.createDataFrame(records, "record binary").mapInArrow(decoded, ", ".join(f"{c} {sql}" for c in columns))


def read_database(spark: SparkSession, url: str, query: str, fetch_size: int = 10_000, by: tuple[str, str, str, int] | None = None, **options: str) -> DataFrame:
    """Rows of a query in a relational database, streamed by the driver's cursor fetch_size rows at a time.

    `by` (column, least, greatest, tasks) divides it by ranges of a number or date over tasks that read side by side;
    rows outside the bounds come with the first and the last. Without it one task reads all.
    """
    reader = spark.read.format("jdbc").options(url=url, fetchsize=str(fetch_size), **options)
    if by is None:
        return reader.option("query", query).load()
    column, least, greatest, tasks = by
    return reader.options(dbtable=f"({query}) q", partitionColumn=column, lowerBound=least, upperBound=greatest, numPartitions=str(tasks)).load()


def query_pairs(text: str) -> list[tuple[str, str]]:
    """(relation, SQL) of a query file: lines in turn name a relation and give its query; blank lines are errors."""
    lines = text.splitlines()
    if not lines or len(lines) % 2 or any(not x.strip() for x in lines):
        raise ValueError("each relation needs a line with its name and one with its query, and no blank lines")
    return [(lines[k].strip(), lines[k + 1].strip()) for k in range(0, len(lines), 2)]


def query_entities(sql: str) -> tuple[tuple[str, str], tuple[str, str]]:
    """Table and column of both ends of SELECT t1.c1, t2.c2 FROM ...; aliases are refused."""
    if re.search(r"\bas\b", sql, re.I):
        raise ValueError("a query must not use AS")
    m = re.match(r"\s*select\s+(\w+)\.(\w+)\s*,\s*(\w+)\.(\w+)\s+from\s", sql, re.I)
    if not m:
        raise ValueError("a query must begin with SELECT table.column, table.column FROM")
    return (m[1], m[2]), (m[3], m[4])
