"""Queries of the training-data operators with their oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvist.llm.encode import encode_column
from kvist.llm.leak import leaked_passages
from kvist.llm.lookalike import look_alike_cases, plain_corpus
from kvist.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from kvist.llm.pii import personal_information, pseudonymised
from kvist.llm.similar import divisible_by_100, most_similar, similar_pairs
from kvist.llm.split import split_fields
from kvist.plans.registry import Catalogue
from kvist.session import table

CATALOGUE = Catalogue()
#: A key for this test data alone; a real one is kept by whoever publishes the text.
TEST_KEY = b"a key of the test data"


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    provisions = split_fields(table(spark, folder, "tek17_dibk"), "tek17_dibk", ["reg_text", "guidance_text"])
    return provisions.unionByName(split_fields(table(spark, folder, "tek17_chunks"), "tek17_chunks", ["text"]))


@CATALOGUE.query("p2_found", """
SELECT 'tek17_dibk' AS item_table, _ord AS item_ord, 'reg_text' AS item_field FROM tek17_dibk WHERE length(reg_text) > 800
UNION ALL SELECT 'tek17_dibk', _ord, 'guidance_text' FROM tek17_dibk WHERE length(guidance_text) > 800
UNION ALL SELECT 'tek17_chunks', _ord, 'text' FROM tek17_chunks WHERE length(text) > 800
""")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).filter("piece = 0").select("item_table", "item_ord", "item_field")


@CATALOGUE.query("p2_pieces")
def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


_LONG = " UNION ALL ".join(f"SELECT '{t}' AS item_table, _ord AS item_ord, '{f}' AS item_field, md5({f}) AS text_md5 FROM {t} WHERE length({f}) > 800" for t, f in (("tek17_dibk", "reg_text"), ("tek17_dibk", "guidance_text"), ("tek17_chunks", "text")))


@CATALOGUE.query("p2_whole", _LONG)
def p2_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces' own parts, joined again: each must give the whole value; pieces over the limit give no row."""
    own = F.struct("piece", F.expr("substring(text, overlap + 1)").alias("own"))
    parts = _pieces(spark, folder).groupBy("item_table", "item_ord", "item_field").agg(F.array_sort(F.collect_list(own)).alias("p"), F.max(F.length("text")).alias("most"), F.max("overlap").alias("back"))
    whole = F.array_join(F.transform("p", lambda x: x["own"]), "")
    return parts.filter("most <= 800 AND back <= 200").select("item_table", "item_ord", "item_field", F.md5(whole).alias("text_md5"))


@CATALOGUE.query("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, folder, "tek17_chunks"))


@CATALOGUE.query("p4_groups")
def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(table(spark, folder, "tek17_chunks"))


@CATALOGUE.query("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return look_alike_cases(table(spark, folder, "tek17_dibk"), table(spark, folder, "tek17_eval_questions"))


@CATALOGUE.query("p5_plain")
def p5_plain(spark: SparkSession, folder: str) -> DataFrame:
    return plain_corpus(table(spark, folder, "tek17_dibk"), table(spark, folder, "tek17_eval_questions"))


@CATALOGUE.query("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(table(spark, folder, "chroma_collection"), "id", "embedding")


@CATALOGUE.query("p6_neighbours")
def p6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return most_similar(table(spark, folder, "chroma_collection"), "id", "embedding", asks=divisible_by_100(F.col("id")))


@CATALOGUE.query("p7_ids")
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_column(table(spark, folder, "documents"), "doc_id", "text")


@CATALOGUE.query("p8_found", """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-zæøå]+') AS w FROM documents),
p AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-zæøå]+') AS w FROM eval_passages),
dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
pg AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM p))
SELECT DISTINCT doc_id, item_id FROM dg JOIN pg USING (g)
""")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    leaks = leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_passages"))
    return leaks.filter("longest >= 12").select("doc_id", "item_id")


@CATALOGUE.query("p8_leaks")
def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_passages"))


@CATALOGUE.query("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_information(table(spark, folder, "documents"), table(spark, folder, "person_names"))


@CATALOGUE.query("p9_text")
def p9_text(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymised(table(spark, folder, "documents"), table(spark, folder, "person_names"), TEST_KEY)
