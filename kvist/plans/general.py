"""Queries of the general data problems: snapshots and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvist.functions.plain import identifier_table
from kvist.operators.copies import compare_run_logs
from kvist.operators.snapshots import section_changes
from kvist.plans.registry import Catalogue
from kvist.session import table

CATALOGUE = Catalogue()
_FROM, _TO = (x.replace("'", "''") for x in identifier_table())

#: The plain section id as DuckDB SQL over a column ``section_id``.
PLAIN_SQL = f"""trim(regexp_replace(translate(section_id, '{_FROM}', '{_TO}'), ' +', ' ', 'g'))"""
SECTION_SQL = f"""CASE WHEN regexp_matches({PLAIN_SQL}, '^(§ ?)*[0-9]{{1,2}} ?- ?[0-9]{{1,2}} ?[a-zA-Z]?$')
    THEN '§ ' || replace(replace({PLAIN_SQL}, '§', ''), ' ', '') WHEN {PLAIN_SQL} <> '' THEN {PLAIN_SQL} END"""


@CATALOGUE.query("p1_found", f"""
WITH lines AS (
    SELECT url, CAST(replace(trim(downloaded_at), 'T', ' ') AS timestamp) AS tm, downloaded_at, sha256, _ord
    FROM manifest WHERE status = 200 AND trim(path) <> '' AND lower(content_type) LIKE '%text/html%'),
d AS (
    SELECT url, tm, arg_max(downloaded_at, _ord) AS label, arg_max(sha256, _ord) AS sha256 FROM lines GROUP BY url, tm),
deliveries AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY tm) AS idx FROM d),
plain AS (SELECT root_print_url AS url, sha256, {SECTION_SQL} AS section, title, reg_text, guidance_text, _ord FROM tek17_dibk),
content AS (
    SELECT url, sha256, section, title, reg_text, guidance_text FROM plain WHERE section IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY url, sha256, section ORDER BY _ord DESC) = 1),
at_each AS (SELECT d.url, d.idx, c.section, c.title, c.reg_text, c.guidance_text FROM deliveries d JOIN content c USING (url, sha256)),
pairs AS (
    SELECT coalesce(n.url, o.url) AS url, coalesce(n.idx, o.idx + 1) AS idx, coalesce(n.section, o.section) AS section,
        CASE WHEN o.idx IS NULL THEN 'added' WHEN n.idx IS NULL THEN 'removed'
            WHEN n.title IS DISTINCT FROM o.title OR n.reg_text IS DISTINCT FROM o.reg_text OR n.guidance_text IS DISTINCT FROM o.guidance_text
            THEN 'changed' END AS change
    FROM at_each n FULL JOIN at_each o ON n.url = o.url AND n.section = o.section AND n.idx = o.idx + 1)
SELECT p.url AS root_print_url, d.label AS downloaded_at, p.section AS section_id, p.change
FROM pairs p JOIN deliveries d ON p.url = d.url AND p.idx = d.idx WHERE p.idx > 1 AND p.change IS NOT NULL
""")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return section_changes(table(spark, folder, "manifest"), table(spark, folder, "tek17_dibk"))


@CATALOGUE.query("p3_found", """
WITH a AS (
    SELECT regexp_replace(id, '^[ \\t]+|[ \\t]+$', '', 'g') AS k, model_refused, coalesce(any_hit, retrieval_hit) AS any_hit, full_hit FROM run_log_a
    WHERE regexp_replace(id, '^[ \\t]+|[ \\t]+$', '', 'g') <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY _ord DESC) = 1),
b AS (
    SELECT regexp_replace(id, '^[ \\t]+|[ \\t]+$', '', 'g') AS k, model_refused, coalesce(any_hit, retrieval_hit) AS any_hit, full_hit FROM run_log_b
    WHERE regexp_replace(id, '^[ \\t]+|[ \\t]+$', '', 'g') <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY _ord DESC) = 1)
SELECT k AS id, 'missing_in_b' AS diff FROM a WHERE k NOT IN (SELECT k FROM b)
UNION ALL SELECT k, 'missing_in_a' FROM b WHERE k NOT IN (SELECT k FROM a)
UNION ALL SELECT a.k, 'model_refused' FROM a JOIN b USING (k) WHERE a.model_refused IS DISTINCT FROM b.model_refused
UNION ALL SELECT a.k, 'any_hit' FROM a JOIN b USING (k) WHERE a.any_hit IS DISTINCT FROM b.any_hit
UNION ALL SELECT a.k, 'full_hit' FROM a JOIN b USING (k) WHERE a.full_hit IS DISTINCT FROM b.full_hit
""")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return compare_run_logs(table(spark, folder, "run_log_a"), table(spark, folder, "run_log_b"))
