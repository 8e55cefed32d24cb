"""Queries of retrieval. Searches take as queries the rows whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvist.functions import text as T
from kvist.operators import retrieval as R
from kvist.plans import duck as D
from kvist.plans.registry import Catalogue
from kvist.session import scratch, table

CATALOGUE = Catalogue()
K = 6


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tek17_eval_questions").filter("_ord % 100 = 0")


def hex_divisible(ident: Column) -> Column:
    """Is the number that a hexadecimal id of 24 digits states divisible by 100?"""
    half = lambda at: F.conv(F.substring(ident, at, 12), 16, 10).cast("bigint") % 100
    return (half(1) * (2**48 % 100) + half(13)) % 100 == 0


HEX_SQL = f"((('0x' || substr(id, 1, 12))::BIGINT % 100) * {2**48 % 100} + ('0x' || substr(id, 13, 12))::BIGINT % 100) % 100 = 0"


@CATALOGUE.query("tokenize_counts", f"SELECT _ord, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT _ord, {D.tokens('text')} AS t FROM tek17_chunks)")
def tokenize_counts(spark, folder):
    t = table(spark, folder, "tek17_chunks").select("_ord", T.tokens(F.col("text")).alias("t"))
    return t.select("_ord", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@CATALOGUE.query("bm25_df", f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({D.tokens('text')})) AS token FROM tek17_chunks) GROUP BY token")
def bm25_df(spark, folder):
    return R.document_frequencies(table(spark, folder, "tek17_chunks"), "text")


@CATALOGUE.query("bm25_stats", f"SELECT count(*) AS n, round(coalesce(avg(len({D.tokens('text')})), 0), 6) AS avgdl FROM tek17_chunks")
def bm25_stats(spark, folder):
    return R.corpus_stats(table(spark, folder, "tek17_chunks"), "text").select("n", F.round("avgdl", 6).alias("avgdl"))


def _bm25_sql(queries: str, docs: str, k: int) -> str:
    """CTEs ending in ``sparse`` (qid, ord, score, rank, distance); queries (qid, q), docs (ord, text)."""
    return f"""
q AS (SELECT qid, unnest(list_distinct({D.tokens('q')})) AS token FROM ({queries})),
d AS (SELECT ord, {D.tokens('text')} AS t FROM ({docs})),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT ord, dl, token, count(*) AS tf FROM (SELECT ord, len(t) AS dl, unnest(t) AS token FROM d) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
sc AS (SELECT qid, ord, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
    FROM q JOIN tf USING (token) JOIN df USING (token), st GROUP BY qid, ord),
sparse AS (SELECT *, 1 - score / max(score) OVER (PARTITION BY qid) AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, ord) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})"""


_QUESTIONS_SQL = "SELECT _ord AS qid, question AS q FROM tek17_eval_questions WHERE _ord % 100 = 0"
_CHUNKS_SQL = "SELECT _ord AS ord, text FROM tek17_chunks"


@CATALOGUE.query("bm25_topk", f"WITH {_bm25_sql(_QUESTIONS_SQL, _CHUNKS_SQL, K)} SELECT qid, ord, rank, round(score, 6) AS score, round(distance, 6) AS distance FROM sparse")
def bm25_topk(spark, folder):
    top = R.sparse_top_k(_questions(spark, folder), table(spark, folder, "tek17_chunks"), K, "_ord", "question", "_ord", "text")
    return top.select("qid", "ord", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


@CATALOGUE.query("bm25_index_topk", f"WITH {_bm25_sql(_QUESTIONS_SQL, _CHUNKS_SQL, K)} SELECT qid, ord, rank, round(score, 6) AS score FROM sparse")
def bm25_index_topk(spark, folder):
    """The same ranking from a written index."""
    path = scratch(spark)
    R.write_index(table(spark, folder, "tek17_chunks"), path, "_ord", "text")
    scored = R.index_scores(_questions(spark, folder), path, "_ord", "question", k=K)
    top = R.best_first(scored.filter("score > 0"), K, F.col("score"), "ord")
    return top.select("qid", "ord", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def _dense_sql(k: int) -> str:
    return f"""
usable AS (SELECT id, embedding::DOUBLE[] AS v FROM chroma_collection WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda z: abs(z))) > 0),
asked AS (SELECT id AS qid, v AS qv FROM usable WHERE {HEX_SQL}),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(-distance, 9) DESC, id) AS rank FROM (
    SELECT qid, id, 1 - list_cosine_similarity(qv, v) AS distance FROM asked, usable)) WHERE rank <= {k})"""


@CATALOGUE.query("dense_topk", f"WITH {_dense_sql(K)} SELECT qid, id, rank, round(distance, 5) + 0.0 AS distance FROM dense")
def dense_topk(spark, folder):
    all_rows = table(spark, folder, "chroma_collection")
    top = R.dense_top_k(all_rows.filter(hex_divisible(F.col("id"))), all_rows, K, "id", "embedding", "id", "embedding")
    return top.select("qid", "id", F.col("rank").cast("bigint").alias("rank"), (F.round("distance", 5) + F.lit(0.0)).alias("distance"))


_KEY_SQL = """CASE WHEN k = '||||' THEN sha256(coalesce(document, '')) ELSE k END"""
_META_SQL = "concat_ws('|', coalesce(metadata.section_id, ''), coalesce(metadata.title, ''), coalesce(metadata.text_type, ''), coalesce(metadata.para_start::VARCHAR, ''), coalesce(metadata.para_end::VARCHAR, ''))"


@CATALOGUE.query("fusion_keys", f"SELECT id, {_KEY_SQL} AS key FROM (SELECT id, document, {_META_SQL} AS k FROM chroma_collection)")
def fusion_keys(spark, folder):
    return table(spark, folder, "chroma_collection").select("id", T.fusion_key(F.col("document"), F.col("metadata")).alias("key"))


def _hybrid_sides(spark, folder):
    rows = table(spark, folder, "chroma_collection").withColumn("key", T.fusion_key(F.col("document"), F.col("metadata")))
    asked = rows.filter(hex_divisible(F.col("id")))
    wide = K * R.CANDIDATES
    keys = rows.select("id", "key")
    dense = R.join_found(R.dense_top_k(asked, rows, wide, "id", "embedding", "id", "embedding"), keys, "id")
    sparse = R.join_found(R.sparse_top_k(asked, rows, wide, "id", "document", "id", "document"), keys.withColumnRenamed("id", "ord"), "ord")
    return dense.select("qid", "key", "distance"), sparse.select("qid", "key", "distance")


_HYBRID_SQL = f"""{_dense_sql(K * 3)},
{_bm25_sql(f"SELECT id AS qid, document AS q FROM chroma_collection WHERE {HEX_SQL}", "SELECT id AS ord, document AS text FROM chroma_collection", K * 3)},
keys AS (SELECT id, {_KEY_SQL} AS key FROM (SELECT id, document, {_META_SQL} AS k FROM chroma_collection)),
ds AS (SELECT qid, key, max(1 / (1 + distance)) AS s FROM dense JOIN keys USING (id) GROUP BY ALL),
ss AS (SELECT qid, key, max(1 - distance) AS s FROM sparse JOIN keys ON ord = id GROUP BY ALL),
dn AS (SELECT qid, key, s / CASE WHEN max(s) OVER (PARTITION BY qid) > 0 THEN max(s) OVER (PARTITION BY qid) ELSE 1 END AS s FROM ds),
sn AS (SELECT qid, key, s / CASE WHEN max(s) OVER (PARTITION BY qid) > 0 THEN max(s) OVER (PARTITION BY qid) ELSE 1 END AS s FROM ss),
both_sides AS (SELECT coalesce(dn.qid, sn.qid) AS qid, coalesce(dn.key, sn.key) AS key, coalesce(dn.s, 0) AS d, coalesce(sn.s, 0) AS s FROM dn FULL JOIN sn ON dn.qid = sn.qid AND dn.key = sn.key)"""


@CATALOGUE.query("hybrid_topk", f"""WITH {_HYBRID_SQL}
SELECT qid, key, rank, round(1 - c, 5) + 0.0 AS distance FROM (SELECT qid, key, 0.5 * d + 0.5 * s AS c, row_number() OVER (PARTITION BY qid ORDER BY round(0.5 * d + 0.5 * s, 9) DESC, key) AS rank FROM both_sides) WHERE rank <= {K}""")
def hybrid_topk(spark, folder):
    top = R.fuse(*_hybrid_sides(spark, folder), K, 0.5)
    return top.select("qid", "key", F.col("rank").cast("bigint").alias("rank"), (F.round("distance", 5) + F.lit(0.0)).alias("distance"))


@CATALOGUE.query("sweep_alpha", f"""WITH {_HYBRID_SQL}, al AS (SELECT unnest([0.25, 0.5, 0.75, 0.9])::DOUBLE AS alpha)
SELECT alpha, qid, key, rank FROM (SELECT alpha, qid, key, row_number() OVER (PARTITION BY alpha, qid ORDER BY round(alpha * d + (1 - alpha) * s, 9) DESC, key) AS rank FROM both_sides, al) WHERE rank <= {K}""")
def sweep_alpha(spark, folder):
    alphas = spark.createDataFrame([(a,) for a in (0.25, 0.5, 0.75, 0.9)], "alpha double")
    cross = lambda df: df.crossJoin(F.broadcast(alphas)).withColumn("qid", F.struct("alpha", "qid"))
    dense, sparse = _hybrid_sides(spark, folder)
    top = R.fuse(cross(dense), cross(sparse), K, F.col("qid.alpha"))
    return top.select("qid.alpha", "qid.qid", "key", F.col("rank").cast("bigint").alias("rank"))


def _retrieved(spark, folder, method):
    """A ranking of the collection as it is, whose keys repeat: rows are ranked by themselves, keys matter in the fusion alone."""
    rows = table(spark, folder, "chroma_collection").withColumn("key", T.fusion_key(F.col("document"), F.col("metadata")))
    asked = rows.filter(hex_divisible(F.col("id"))).select(F.col("id").alias("qid"), F.col("document").alias("question"), "embedding")
    top = R.retrieve(method, K, asked, rows.select("id", "key", "embedding"), rows.select(F.col("id").alias("ord"), "key", F.col("document").alias("text")))
    return top.select("qid", "side", "id", "key", F.col("rank").cast("bigint").alias("rank"), (F.round("distance", 5) + F.lit(0.0)).alias("distance"))


_SPARSE_OWN = _bm25_sql(f"SELECT id AS qid, document AS q FROM chroma_collection WHERE {HEX_SQL}", "SELECT id AS ord, document AS text FROM chroma_collection", K)


@CATALOGUE.query("retrieve_dense", f"WITH {_dense_sql(K)}, keys AS (SELECT id, {_KEY_SQL} AS key FROM (SELECT id, document, {_META_SQL} AS k FROM chroma_collection)) SELECT qid, 'dense' AS side, id, key, rank, round(distance, 5) + 0.0 AS distance FROM dense JOIN keys USING (id)")
def retrieve_dense(spark, folder):
    return _retrieved(spark, folder, "dense")


@CATALOGUE.query("retrieve_sparse", f"WITH {_SPARSE_OWN}, keys AS (SELECT id, {_KEY_SQL} AS key FROM (SELECT id, document, {_META_SQL} AS k FROM chroma_collection)) SELECT qid, 'sparse' AS side, id, key, rank, round(distance, 5) + 0.0 AS distance FROM sparse JOIN keys ON ord = id")
def retrieve_sparse(spark, folder):
    return _retrieved(spark, folder, "sparce")


@CATALOGUE.query("retrieve_hybrid", f"""WITH {_HYBRID_SQL},
rows_found AS (SELECT qid, key, 'dense' AS side, id, 0 AS o, distance FROM dense JOIN keys USING (id) UNION ALL SELECT qid, key, 'sparse', id, 1, distance FROM sparse JOIN keys ON ord = id),
payload AS (SELECT qid, key, side, id FROM rows_found QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY o, round(distance, 9), id) = 1)
SELECT qid, side, id, key, rank, round(1 - c, 5) + 0.0 AS distance FROM (SELECT qid, key, 0.5 * d + 0.5 * s AS c, row_number() OVER (PARTITION BY qid ORDER BY round(0.5 * d + 0.5 * s, 9) DESC, key) AS rank FROM both_sides) JOIN payload USING (qid, key) WHERE rank <= {K}""")
def retrieve_hybrid(spark, folder):
    return _retrieved(spark, folder, "hybrid")


def _ranked(spark, folder):
    """The ranking of each question with its own k, and the facts of its chunks."""
    q = _questions(spark, folder).select(F.col("_ord").alias("qid"), "requires_qualification", "target_sections")
    c = table(spark, folder, "tek17_chunks").select(F.col("_ord").alias("ord"), "text", "metadata")
    top = R.sparse_top_k(_questions(spark, folder), table(spark, folder, "tek17_chunks"), R.QUALIFICATION_K, "_ord", "question", "_ord", "text").join(q, "qid")
    return R.join_found(top.filter(F.col("rank") <= R.effective_k(K, F.col("requires_qualification"))), c, "ord")


_PER_K = f"""WITH {_bm25_sql(_QUESTIONS_SQL, _CHUNKS_SQL, 10)},
own AS (SELECT s.qid, s.ord, s.rank, s.distance, coalesce(e.requires_qualification, false) AS need, e.target_sections, c.text, c.metadata.section_id AS section_id
    FROM sparse s JOIN tek17_eval_questions e ON s.qid = e._ord JOIN tek17_chunks c ON s.ord = c._ord WHERE s.rank <= CASE WHEN coalesce(e.requires_qualification, false) THEN 10 ELSE {K} END)"""


@CATALOGUE.query("per_query_k", f"{_PER_K} SELECT qid, ord, rank FROM own")
def per_query_k(spark, folder):
    return _ranked(spark, folder).select("qid", "ord", F.col("rank").cast("bigint").alias("rank"))


_FILTERED = f"""{_PER_K},
f AS (SELECT *, need AND coalesce(list_contains({D.chapters('target_sections')}, {D.chapter('section_id')}), false) AS inside FROM own),
kept AS (SELECT * FROM (SELECT *, bool_or(inside) OVER (PARTITION BY qid) AS met FROM f) WHERE inside OR NOT met)"""


@CATALOGUE.query("chapter_filter", f"{_FILTERED} SELECT qid, ord, rank FROM kept")
def chapter_filter(spark, folder):
    rows = _ranked(spark, folder).withColumn("section_id", F.col("metadata.section_id"))
    return R.chapter_filter(rows, "requires_qualification", "target_sections", "section_id").select("qid", "ord", F.col("rank").cast("bigint").alias("rank"))


@CATALOGUE.query("context_assembly", f"{_FILTERED} SELECT qid, count(*) AS n, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM kept GROUP BY qid")
def context_assembly(spark, folder):
    rows = _ranked(spark, folder).withColumn("section_id", F.col("metadata.section_id"))
    kept = R.chapter_filter(rows, "requires_qualification", "target_sections", "section_id")
    return R.assemble_context(kept, "section_id").select("qid", F.size("sources").cast("bigint").alias("n"), F.md5("context").alias("context_md5"))


@CATALOGUE.query("recall_at_k", f"""WITH {_bm25_sql(_QUESTIONS_SQL, _CHUNKS_SQL, K)},
got AS (SELECT qid, list(coalesce(c.metadata.section_id, '')) AS r FROM sparse JOIN tek17_chunks c ON ord = c._ord GROUP BY qid),
x AS (SELECT coalesce(e.requires_qualification, false) AS need, {D.section_set('e.target_sections')} AS t, {D.section_set('g.r')} AS r FROM tek17_eval_questions e LEFT JOIN got g ON e._ord = g.qid WHERE e._ord % 100 = 0 AND len(e.target_sections) > 0),
h AS (SELECT len(t) > 0 AND list_has_any(r, t) AS a, need, len(t) > 0 AND list_has_all(r, t) AS f FROM x)
SELECT count(*) AS n, round(avg(a::INT), 6) AS any_hit_recall, round(avg((CASE WHEN need THEN a ELSE f END)::INT), 6) AS full_hit_recall FROM h HAVING count(*) > 0""")
def recall_at_k(spark, folder):
    from kvist.operators.answering import recall_log
    from kvist.operators.summaries import recall_at_k as recall

    q = _questions(spark, folder).withColumn("id", F.col("_ord"))
    c = table(spark, folder, "tek17_chunks").withColumn("key", F.col("_ord"))
    top = R.sparse_top_k(q, c, K, "_ord", "question", "_ord", "text").withColumnRenamed("ord", "key")
    log = recall_log(q, top.select("qid", "key", "rank"), c, "key").withColumn("run", F.lit("bm25"))
    return recall(log).select("n", F.round("any_hit_recall", 6).alias("any_hit_recall"), F.round("full_hit_recall", 6).alias("full_hit_recall"))
