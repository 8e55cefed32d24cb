"""JSON Lines and CSV: scans with explicit schemas, and sinks."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvist.session import broadcast_if_small


#: Bits of ``_ord`` that hold the place within a file; the others hold the file's number.
PLACE_BITS = 43


def file_order(name: str) -> tuple:
    """Sorts file names with their numbers read as numbers, so that part files keep the order of their writing."""
    return tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"([0-9]+)", name) if x)


def run_of(path: Column) -> Column:
    """The run that a file belongs to: the file's name, or its folder's name for part files."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.startswith(name, F.lit("part-")), F.element_at(F.split(path, "/"), -2)).otherwise(name)


def run_names(spark: SparkSession, path: str | list[str], run: str = "run") -> DataFrame:
    """(run): the runs of all files, those without records included."""
    return spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "p string").select(run_of(F.col("p")).alias(run)).distinct()


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, lenient: bool = False, run: str | None = None) -> DataFrame:
    """Records of JSON Lines with ``_ord``, growing with the file's name (see file_order) and with the line within it.

    Blank lines are skipped. Malformed lines raise, or are dropped if lenient. Missing keys are null.
    run: a column that takes the run's name (see run_of), so that many files are one scan.
    """
    corrupt = "_corrupt_record"
    with_bad = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    lines = spark.read.text(path)
    # The place of a line: where its split begins, and its number in the scan's partition. A split that isn't
    # its file's last one fills a partition, so that places within a file grow.
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    own = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    rows = lines.select("value", place.alias("_place"), own.alias("_path"), *([run_of(F.col("_metadata.file_path")).alias(run)] if run else []))
    files = sorted({re.sub("^file:/+", "file:/", f) for f in lines.inputFiles()}, key=file_order)
    if len(files) > 1:
        numbered = spark.createDataFrame([(f, n) for n, f in enumerate(files)], "_path string, _file bigint")
        rows = rows.join(broadcast_if_small(numbered), "_path").withColumn("_ord", F.col("_file") * (1 << PLACE_BITS) + F.col("_place"))
    else:
        rows = rows.withColumnRenamed("_place", "_ord")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    parsed = rows.filter(F.trim("value") != "").select("_ord", *([run] if run else []), "value", F.from_json("value", with_bad, options).alias("r"))
    if lenient:
        parsed = parsed.filter(F.col(f"r.{corrupt}").isNull())
    else:
        parsed = parsed.withColumn("r", F.when(F.col(f"r.{corrupt}").isNotNull(), F.raise_error(F.concat(F.lit("malformed record: "), F.substring("value", 1, 200)))).otherwise(F.col("r")))
    return parsed.select("_ord", *([run] if run else []), *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """One JSON object per line, null fields kept; single: one file, for people to read, not for large results.

    Part files follow the order of df's partitions, and read_jsonl reads them in that order.
    """
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_line(spark: SparkSession, record: dict, path: str) -> None:
    """Append one JSON line: to the file at path (made where there is none), or as a new last file to the folder at path."""
    line = (json.dumps(record, ensure_ascii=False) + "\n").encode()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where) and fs.getFileStatus(where).isDirectory():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(where, f"part-{10**9}-{time.time_ns():020d}.json"), False)
    elif fs.getUri().getScheme() == "file":
        os.makedirs(os.path.dirname(os.path.abspath(where.toUri().getPath())), exist_ok=True)
        with open(where.toUri().getPath(), "ab") as f:
            f.write(line)
        return
    else:
        out = fs.append(where) if fs.exists(where) else fs.create(where, False)
    out.write(bytearray(line))
    out.close()


def write_csv(parts: list[DataFrame], path: str, single: bool = True) -> None:
    """A CSV with header; the columns of all parts, in first-seen order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.select([F.to_json(c).alias(c) if isinstance(out.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in out.columns])
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def last_wins(df: DataFrame, key: str, order: str = "_ord", keep: str = "last") -> DataFrame:
    """One row per key that isn't blank: the last (or first) by order, as max_by so that a hot key is combined on the map side."""
    pick = F.max_by if keep == "last" else F.min_by
    names = df.columns
    return df.filter(F.trim(F.col(key)) != "").groupBy(F.col(key).alias("_key")).agg(pick(F.struct(*names), order).alias("_r")).select("_r.*")


def read_chunks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Chunks for the sparse index: missing texts are empty."""
    return read_jsonl(spark, path, schema).withColumn("text", F.coalesce("text", F.lit("")))


def validate_chunks(chunks: DataFrame) -> DataFrame:
    """Raises at run time on a chunk without text or metadata."""
    bad = F.col("text").isNull() | F.col("metadata").isNull()
    return chunks.withColumn("text", F.when(bad, F.raise_error(F.lit("a chunk needs text and metadata"))).otherwise(F.col("text")))


def tsv_report(df: DataFrame, limit: int = 1000, digits: int = 3) -> str:
    """A tab-separated report of up to ``limit`` rows of a summary; the limit is the report's, not the data's."""
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    return "\n".join(["\t".join(df.columns), *("\t".join(map(show, r)) for r in df.limit(limit).collect())])
