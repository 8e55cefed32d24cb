"""Session helpers: reading tables, cutting lineage in the shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a side that may be broadcast.
BROADCAST_LIMIT = 8 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master gets a folder of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kvist-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the JVM ends."""
    path = f"{shared_folder(spark)}/kvist-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, partitions: int | None = None, dictionary: bool = True) -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it again.

    Cuts the lineage, survives lost executors, keeps columns prunable; removed when the JVM ends.
    dictionary: whether repeated values are looked for; hashes and vectors have none.
    """
    spark = df.sparkSession
    path = scratch(spark)
    (df.repartition(partitions) if partitions else df).write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Spread a scan over all cores where it has fewer partitions than these; larger scans stay as they are.

    For costly work per row over few files: only plans without exchange, of selected columns, hashed by a unique key.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores, *key) if held < cores else df


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df (files' sizes for scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only where Catalyst's estimate is under the limit; else the planner shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name of one or more DataFrames."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
