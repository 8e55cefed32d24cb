"""The manifest as a stream: its lines are appended, the latest valid snapshot of each url is kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvist.session import scratch
from kvist.sources.manifest import is_valid


def latest_valid_stream(lines: DataFrame) -> DataFrame:
    """A streaming aggregate (url, path, sha256, _ord): the state holds one line per url, whatever the order of arrival."""
    best = F.max_by(F.struct("path", "sha256", "_ord"), "_ord")
    return lines.filter(is_valid()).groupBy("url").agg(best.alias("r")).select("url", "r.*")


def latest_by_stream(spark: SparkSession, written: DataFrame) -> DataFrame:
    """Run the stream over a written table's files until all are read; the result as a table in the shared folder.

    Each trigger's complete result replaces the table, so a restarted query repeats no effect.
    """
    base = scratch(spark)
    source = written.inputFiles()[0].rsplit("/", 1)[0] if written.inputFiles() else None
    if source is None:
        return latest_valid_stream(written)
    lines = spark.readStream.schema(written.schema).parquet(source)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result")

    query = latest_valid_stream(lines).writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema("url string, path string, sha256 string, _ord bigint").parquet(f"{base}/result")
