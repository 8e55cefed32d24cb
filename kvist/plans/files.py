"""Queries of the files that steps exchange: each writes a whole table into the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvist.operators import summaries as S
from kvist.plans import duck as D
from kvist.plans.registry import Catalogue
from kvist.plans.scoring import CELLS, cells_sql, runs_of
from kvist.schema import CHUNKS, QUESTIONS, RUN_LOG
from kvist.session import scratch, table
from kvist.sources import records as R

CATALOGUE = Catalogue()
_LINE = T.StructField("line", T.LongType())


def _written(spark, folder, name, schema, *columns):
    """A table's records as JSON Lines, with their number."""
    path = scratch(spark)
    R.write_jsonl(table(spark, folder, name).select(F.col("_ord").alias("line"), *columns), path)
    return path, T.StructType([_LINE, *schema.fields])


@CATALOGUE.query("jsonl_round_trip", """
SELECT _ord AS line, id, question, array_to_string(target_sections, '|') AS targets, should_refuse, refusal_type, notes FROM tek17_eval_questions""")
def jsonl_round_trip(spark, folder):
    path, schema = _written(spark, folder, "tek17_eval_questions", QUESTIONS, *QUESTIONS.fieldNames())
    return R.read_jsonl(spark, path, schema).select("line", "id", "question", F.array_join("target_sections", "|").alias("targets"), "should_refuse", "refusal_type", "notes")


@CATALOGUE.query("chunk_scan", "SELECT _ord AS line, md5(coalesce(text, '')) AS text_md5, metadata.section_id AS section_id, metadata.para_end AS para_end FROM tek17_chunks")
def chunk_scan(spark, folder):
    """Chunks for the sparse index, missing texts empty."""
    path, schema = _written(spark, folder, "tek17_chunks", CHUNKS, "text", "metadata")
    return R.read_chunks(spark, path, schema).select("line", F.md5("text").alias("text_md5"), "metadata.section_id", "metadata.para_end")


@CATALOGUE.query("run_files", """
SELECT 'run_a' AS run, count(*) AS n, count(DISTINCT id) AS ids, sum(top_k)::BIGINT AS k FROM run_log_a UNION ALL SELECT 'run_b', count(*), count(DISTINCT id), sum(top_k)::BIGINT FROM run_log_b""")
def run_files(spark, folder):
    """Many runs' files as one scan, told apart by the file's name."""
    base = scratch(spark)
    for x in "ab":
        R.write_jsonl(table(spark, folder, f"run_log_{x}").select(*RUN_LOG.fieldNames()), f"{base}/run_{x}")
    logs = R.read_jsonl(spark, f"{base}/*", RUN_LOG, run="run")
    return logs.groupBy("run").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("top_k").alias("k"))


_RUNS = "runs AS (SELECT 'a' AS run, * FROM run_log_a UNION ALL BY NAME SELECT 'b' AS run, * FROM run_log_b)"
_KIND = f"coalesce(nullif({D.strip('refusal_type')}, ''), '(unspecified)')"


@CATALOGUE.query("csv_round_trip", f"""WITH {_RUNS}, c AS (SELECT run, {cells_sql()} FROM runs GROUP BY run),
t AS (SELECT run, {_KIND} AS refusal_type, count(*) AS n, count(*) FILTER (WHERE coalesce(model_refused, false)) AS refused FROM runs WHERE coalesce(status <> 'query_failed', true) AND coalesce(should_refuse, false) GROUP BY ALL)
SELECT run, {', '.join(f'{x}::VARCHAR AS {x}' for x in CELLS)}, NULL::VARCHAR AS refusal_type, NULL::VARCHAR AS n, NULL::VARCHAR AS refused FROM c
UNION ALL SELECT run, {', '.join('NULL' for _ in CELLS)}, refusal_type, n::VARCHAR, refused::VARCHAR FROM t""")
def csv_round_trip(spark, folder):
    """Two summaries with different columns in one CSV."""
    path, runs = scratch(spark), runs_of(spark, folder)
    R.write_csv([S.confusion_matrix(runs), S.refusal_by_type(runs).drop("rate")], path)
    return spark.read.option("header", True).csv(path)
