"""Session helpers: table access, checkpoint folder, whole-partition fan-out."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is installed or sent with ``--py-files``; this covers drivers that only
    extended their own ``sys.path``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    includes = getattr(spark.sparkContext, "_python_includes", None)
    if includes is not None and root not in includes:
        includes.append(root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a test-data folder."""
    importable(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests on one
    machine) is a folder of our own made.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(got)
        return got
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="timberline-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends, executors may be lost.

    What was written is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str, at_least: int = 0) -> DataFrame:
    """Repartition to the session's parallelism, by ``keys`` if given."""
    n = max(parallelism(df.sparkSession), at_least)
    return df.repartition(n, *[F.col(k) for k in keys]) if keys else df.repartition(n)


def fan_out(df: DataFrame) -> DataFrame:
    """Spread rows that come in fewer partitions than there are cores, before per-row Python work.

    Tables stored in enough files are left as they are: no shuffle at scale.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
