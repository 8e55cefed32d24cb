"""The vector collection as a Parquet table: full refresh, opening, fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvist.functions.text import stable_chunk_id
from kvist.sources.records import last_wins


def collection_of(embedded: DataFrame) -> DataFrame:
    """(id, embedding, document, metadata) of embedded chunks (text, metadata, embedding, _ord); of equal ids the last stays."""
    rows = embedded.select(stable_chunk_id(F.col("text"), F.col("metadata")).alias("id"), "embedding", F.col("text").alias("document"), "metadata", "_ord")
    return last_wins(rows, "id").drop("_ord")


def refresh(embedded: DataFrame, path: str) -> int:
    """Replace the collection at path; the number of its rows."""
    collection_of(embedded).write.mode("overwrite").parquet(path)
    return embedded.sparkSession.read.parquet(path).count()


def open_collection(spark: SparkSession, path: str) -> DataFrame:
    """The collection at path; RuntimeError where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise RuntimeError(f"no vector collection at {path}; run the ingest first")
    return spark.read.parquet(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """(count, sha256): rows, and a hash over their content that doesn't depend on their order.

    Rows are hashed, the hashes summed up by their first 12 hex digits' buckets and in all, so that no
    list of all rows' hashes is gathered in one place.
    """
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")) for c in sorted(df.columns)]), 256)
    word = lambda k: F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("h")).agg(F.count("*").alias("count"), *[F.coalesce(F.sum(word(k)), F.lit(0)).cast("string").alias(f"s{k}") for k in range(5)])
    return sums.select("count", F.sha2(F.concat_ws("|", F.col("count").cast("string"), *[f"s{k}" for k in range(5)]), 256).alias("sha256"))


def fingerprint_sql(table: str, row_sql: str) -> str:
    """The same fingerprint as DuckDB SQL over a row hash expression."""
    sums = ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 12 * k}, 12))::HUGEINT), 0)::VARCHAR AS s{k}" for k in range(5))
    return f"SELECT c AS count, sha256(concat_ws('|', c::VARCHAR, s0, s1, s2, s3, s4)) AS sha256 FROM (SELECT count(*) AS c, {sums} FROM (SELECT {row_sql} AS h FROM {table}))"
