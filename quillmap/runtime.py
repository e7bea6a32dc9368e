"""Session helpers shared by all operators: tables, materialisation, blocks."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share. The cluster names it in spark.checkpoint.dir; only where
    that is unset (tests, a single machine) a temporary folder is taken."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"quillmap-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir("file://" + own)
    return "file://" + own


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one. It is removed when the process ends, or by `release`."""
    path = f"{shared_dir(spark)}/quillmap-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(release, spark)
    return path


_OWN: set[str] = set()


def release(spark: SparkSession) -> None:
    """Removes the tables that `materialize` wrote for this application; results that still read them must have been written."""
    for path in list(_OWN):
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration() if spark._jsc else spark._jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
        except Exception:  # the virtual machine ended first; the folder stays for whoever clears the shared one
            pass
        _OWN.discard(path)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it back. Cuts lineage, survives the loss
    of executors (files are not tied to one), and costs compressed columns instead of row blocks."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _free_shuffles(spark)
    held = spark.read.schema(df.schema).parquet(path)
    held._quillmap_path = path
    return held


#: Least seconds between two collections of garbage, and when the last one was.
COLLECT_EVERY, _COLLECTED = 5.0, [0.0]


def _free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what has been written: it does so when the driver's virtual machine collects its
    garbage, which by itself it may not do for the whole of a run."""
    if spark._jvm is not None and time.monotonic() - _COLLECTED[0] >= COLLECT_EVERY:
        gc.collect()
        spark._jvm.System.gc()
        _COLLECTED[0] = time.monotonic()


def discard(*held: DataFrame) -> None:
    """Removes tables that `materialize` returned; no plan that is still to run may read them."""
    for df in held:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._quillmap_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def rows_bounded(df: DataFrame, most: int) -> bool:
    """True when df has at most `most` rows; reads no more than most + 1 of them."""
    return df.limit(most + 1).count() <= most


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Round out a scan that is few files (few tasks) before a Python stage. Large tables and tables of many files
    stay as they are scanned. Decided from the plan's size estimate and the list of files; nothing runs."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if size // most >= cores or len(df._jdf.inputFiles()) >= cores:
        return df
    return df.repartition(cores, *cols) if cols else df.repartition(cores)


def norm_blank(c):
    """Lower case, outer white space gone, inner white space one blank."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), r"^ | $", "")


def global_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Adds the row number from 1 in the given order over all rows, without one task that sees them all: a range sort,
    a place within each sorted partition, and the sizes of the partitions before it (a row per partition)."""
    held = materialize(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__m", 33)
    sizes = held.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumnsRenamed({"__p": "__q", "__n": "__k"})
    starts = sizes.join(F.broadcast(before), F.col("__q") < F.col("__p"), "left").groupBy("__p").agg(F.coalesce(F.sum("__k"), F.lit(0)).alias("__s"))
    return held.join(F.broadcast(starts), part == F.col("__p")).withColumn(name, F.col("__s") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__m", "__p", "__s")


def with_total(df: DataFrame, **aggregates) -> DataFrame:
    """Adds aggregates over all rows as columns: one partially aggregated row, sent to the rows it belongs to."""
    one = df.agg(*[a.alias(n) for n, a in aggregates.items()])
    return df.crossJoin(F.broadcast(one))


def with_group(df: DataFrame, keys: list[str], **aggregates) -> DataFrame:
    """Adds aggregates per group as columns: summed on the map side and joined back, so that a group with a third of all
    rows is spread over tasks (as a window over it would not be). Null keys are a group."""
    g = df.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(*[a.alias(n) for n, a in aggregates.items()])
    on = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"__{i}"))
        on = c if on is None else on & c
    return df.join(g, on).drop(*[f"__{i}" for i in range(len(keys))])
