"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, shuffle_partitions: int = 8, driver_memory: str = "12g") -> SparkSession:
    """A session for tests and for the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomgraph")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset (tests) a temporary one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
    return spark.sparkContext.getCheckpointDir()


def _path(spark: SparkSession, name: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and the copy survives lost executors. It is deleted when the application ends, or by discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._loomgraph_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what written() has put into the shared folder for df; nothing else is touched."""
    path = getattr(df, "_loomgraph_path", None)
    if path:
        fs, at = _path(df.sparkSession, path)
        fs.delete(at, True)


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers by way of the shared folder, once per context, so that they need not have it installed."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_loomgraph_shipped", False) or not root.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    name = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(name)
    context._loomgraph_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns of df, spelled exactly so and the first of each; other columns may have equal names, or equal but for case."""
    ship(df.sparkSession)
    wanted, names = set(columns), []
    for i, c in enumerate(df.columns):
        names.append(c if c in wanted else f"_other_{i}")
        wanted.discard(c)
    if wanted:
        raise ValueError(f"no such column: {', '.join(sorted(wanted))}")
    return df.toDF(*names).select(*columns)


#: a table is sent to every worker only if it is known to be no larger than this
BROADCAST_BYTES = 64 * 1024 * 1024


def sent_if_small(df: DataFrame, row_bytes: int, counted: DataFrame | None = None) -> DataFrame:
    """df, marked for broadcast if its rows (or those of `counted`, which is cheaper and has as many) are few enough; otherwise the planner joins it as it sees fit."""
    n = (df if counted is None else counted).count()
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """df in as many tasks as the session has cores, if its files give fewer; any larger table stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
