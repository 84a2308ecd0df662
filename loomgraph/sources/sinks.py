"""Written forms of edges, embeddings, scores, labels and training state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_buckets(parted: DataFrame, path: str, files: int) -> None:
    """Edges as Parquet by (src_part, dst_part), sorted by src, so a subgraph of some partitions reads their files only."""
    parted.repartitionByRange(files, "src_part", "dst_part", "src").sortWithinPartitions("src_part", "dst_part", "src").write.partitionBy("src_part", "dst_part").parquet(path)


def export_embeddings(vectors: DataFrame, mapping: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False, delim: str = ",") -> None:
    """(id, embedding) with raw labels in place of ids, ordered by id within range-partitioned files; CSV joins the numbers with spaces."""
    out = vectors.join(mapping.select(F.col("label").alias("raw"), "id"), "id").repartitionByRange("id").sortWithinPartitions("id").select(F.col("raw").alias("id"), F.col("vec").alias("embedding"))
    mode = "overwrite" if overwrite else "error"
    if fmt.lower() == "parquet":
        out.write.mode(mode).parquet(path)
    elif fmt.lower() == "csv":
        out.select("id", F.concat_ws(" ", F.transform("embedding", lambda x: x.cast("string"))).alias("embedding")).write.mode(mode).option("sep", delim).option("header", True).csv(path)
    else:
        raise ValueError(f"no such format: {fmt}")


def write_scores(scored: DataFrame, path: str) -> None:
    """src[, rel], dst[, rank][, score] with global ids, as CSV with a header."""
    scored.select(*[c for c in ("src", "rel", "dst", "rank", "score") if c in scored.columns]).write.option("header", True).csv(path)


def write_metrics(results: DataFrame, metrics: dict, path: str) -> None:
    """(metric, value) of (rank) or (y_true, y_pred) by name, with the number of rows, as CSV beside the scores."""
    row = results.agg(F.count(F.lit(1)).cast("double").alias("n"), *[c.alias(name) for name, c in metrics.items()])
    names = ["n", *metrics]
    row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`").cast("double") for n in names]))).alias("metric", "value")).write.option("header", True).csv(path)


def export_model(nodes: DataFrame, rels: DataFrame, path: str, overwrite: bool = False) -> None:
    """A trained model, as it is, beside its exported vectors: nodes (id, vec, ...) and rels (kind, id, vec, ...)."""
    for name, df in (("nodes", nodes), ("rels", rels)):
        df.write.mode("overwrite" if overwrite else "error").parquet(f"{path}/{name}")


def write_labels(labels: DataFrame, path: str) -> None:
    labels.select("id", "y_pred", "y_true").write.option("header", True).csv(path)


def save_state(nodes: DataFrame, path: str, epoch: int) -> None:
    """A version of node vectors with their state; a version counts once Spark has marked it as complete."""
    nodes.write.parquet(f"{path}/epoch={epoch}")


def latest_state(spark: SparkSession, path: str) -> tuple[int, DataFrame] | None:
    """The newest complete version, or None."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    epochs = [int(s.getPath().getName()[6:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("epoch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{s.getPath().getName()}/_SUCCESS"))]
    return (max(epochs), spark.read.parquet(f"{path}/epoch={max(epochs)}")) if epochs else None


def forget_before(spark: SparkSession, path: str, epoch: int) -> None:
    """Delete the versions under path that are older than `epoch`."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name.startswith("epoch=") and int(name[6:]) < epoch:
            fs.delete(s.getPath(), True)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
