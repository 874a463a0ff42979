"""Session settings, table access and durable stages.

A stage is a Parquet table written below the folder that ``spark.checkpoint.dir`` names. Writing one
cuts the lineage, survives the loss of any executor and lets later steps read only the columns they need.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SPREAD_BYTES = 256 << 20
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "quernel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, where they would not find it by themselves: neither the
    working folder nor PYTHONPATH, which workers take over, holds it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and os.path.realpath(p) == os.path.realpath(root) for p in found) or getattr(spark, "_quernel_shipped", False):
        return
    at = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="quernel-"), "quernel"), "zip", root, "quernel")
    spark.sparkContext.addPyFile(at)
    spark._quernel_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local session gets one of its own; on a cluster
    that would be lost with each executor, so it is an error there."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quernel-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    spark._quernel_stages = [*getattr(spark, "_quernel_stages", []), path]
    return out


def drop_stages(spark: SparkSession, *stages: DataFrame) -> None:
    """Delete the folders of these stages, or of all that this session has written. Nothing that reads them may be used
    afterwards."""
    paths = [d._stage for d in stages] if stages else list(getattr(spark, "_quernel_stages", []))
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark._quernel_stages = [p for p in getattr(spark, "_quernel_stages", []) if p not in set(paths)]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, dealt over all cores by ``keys``, where the input is small (by the optimizer's estimate at most
    ``SPREAD_BYTES``, whatever the cluster) and comes in fewer splits than there are cores, as a single file of one row
    group does. Anything larger is split by the reader and never moved."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size > SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that is small by definition; raises instead of cutting when it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows
