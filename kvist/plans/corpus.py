"""Queries of the corpus build: snapshots, provisions, documents, units, chunks, ids, the collection, question sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvist.functions import text as T
from kvist.operators import chunking as C
from kvist.operators import questions as Q
from kvist.plans import duck as D
from kvist.plans.registry import Catalogue
from kvist.session import materialize, scratch, table
from kvist.sources import html as H
from kvist.sources import manifest as M
from kvist.sources import store as S
from kvist.sources.records import last_wins

CATALOGUE = Catalogue()
_VALID = "status = 200 AND coalesce(path, '') <> '' AND coalesce(contains(lower(content_type), 'text/html'), false)"


@CATALOGUE.query("latest_valid_snapshot", f"SELECT url, arg_max(path, _ord) AS path, arg_max(sha256, _ord) AS sha256, max(_ord) AS _ord FROM manifest WHERE {_VALID} GROUP BY url")
def latest_valid_snapshot(spark, folder):
    return M.latest_valid(table(spark, folder, "manifest"), "url").select("url", "path", "sha256", "_ord")


@CATALOGUE.query("latest_valid_overall", f"SELECT arg_max(url, _ord) AS url, arg_max(path, _ord) AS path, max(_ord) AS _ord FROM manifest WHERE {_VALID}")
def latest_valid_overall(spark, folder):
    return M.latest_valid(table(spark, folder, "manifest")).select("url", "path", "_ord")


@CATALOGUE.query("manifest_defaults", """
SELECT _ord, coalesce(final_url, url) AS final_url, coalesce(status, 0) AS status, coalesce(path, '') AS path,
    regexp_replace(regexp_replace(regexp_replace(coalesce(final_url, url) || '/;v=1?x=2#y', '[?#].*$', ''), ';[^/;]*$', ''), '/+$', '') AS canonical FROM manifest""")
def manifest_defaults(spark, folder):
    """Canonical urls of urls to which parameters, a query and a fragment are added."""
    m = M.with_defaults(table(spark, folder, "manifest"))
    return m.select("_ord", "final_url", "status", "path", T.canonical_url(F.concat("final_url", F.lit("/;v=1?x=2#y"))).alias("canonical"))


@CATALOGUE.query("path_relocation", """
SELECT _ord, CASE WHEN path = '' THEN '/corpus/' ELSE '/corpus/' || path END AS relative_path, CASE WHEN path = '' THEN '/srv/other/' ELSE '/corpus/' || path END AS moved_path,
    CASE WHEN path = '' THEN '' ELSE sha256(path) END AS content_sha256 FROM (SELECT _ord, coalesce(path, '') AS path FROM manifest)""")
def path_relocation(spark, folder):
    p = F.coalesce("path", F.lit(""))
    moved = F.concat(F.lit("/srv/other/"), p)
    return table(spark, folder, "manifest").select("_ord", T.relocate_path(p, "/corpus").alias("relative_path"), T.relocate_path(moved, "/corpus").alias("moved_path"), M.content_hash(p.cast("binary")).alias("content_sha256"))


@CATALOGUE.query("clean_text", f"SELECT _ord, md5({D.clean('reg_text')}) AS reg_md5, md5({D.clean('guidance_text')}) AS guidance_md5 FROM tek17_dibk")
def clean_text(spark, folder):
    return table(spark, folder, "tek17_dibk").select("_ord", F.md5(T.clean_text(F.col("reg_text"))).alias("reg_md5"), F.md5(T.clean_text(F.col("guidance_text"))).alias("guidance_md5"))


@CATALOGUE.query("full_text", "SELECT _ord, md5(concat_ws(chr(10) || chr(10), nullif(reg_text, ''), nullif(guidance_text, ''))) AS full_md5 FROM tek17_dibk")
def full_text(spark, folder):
    return table(spark, folder, "tek17_dibk").select("_ord", F.md5(H.full_text()).alias("full_md5"))


def _pages(spark, folder):
    """One HTML page per url and content, made of the stored provisions."""
    esc = lambda c: F.replace(F.replace(F.replace(T.text(F.col(c)), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\r"), F.lit(""))
    head = F.when(F.col("chapter").isNotNull(), F.concat(F.lit("<div class='block-header'>"), esc("chapter"), F.lit("</div>"))).otherwise(F.lit(""))
    guide = F.when(T.text(F.col("guidance_text")) != "", F.concat(F.lit("<ul class='guidance-text'><li class='accordion-navigation'><a class='accordion-title'>Veiledning</a><div class='content'><p>"), esc("guidance_text"), F.lit("</div></ul>"))).otherwise(F.lit(""))
    part = F.concat(F.lit("<div class='print-chapter-content'>"), head, F.lit("<h2 class='big-header'>"), esc("section_id"), F.lit(". "), esc("title"), F.lit("</h2><section class='section-big'><p>"), esc("reg_text"), guide, F.lit("</section></div>"))
    rows = table(spark, folder, "tek17_dibk").select("root_print_url", "sha256", "_ord", part.alias("part"))
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "part"))), lambda x: x["part"]), "\n")
    return rows.groupBy("root_print_url", "sha256").agg(F.concat(F.lit("<main class='print-document-content'>"), page, F.lit("</main>")).alias("content")).withColumn("path", F.concat_ws("#", "root_print_url", "sha256"))


_ID_SQL = r"§[\s\p{Z}]*(\p{Nd}{1,2}-\p{Nd}{1,2}[a-zA-Z]?)"


@CATALOGUE.query("html_provisions", f"""
WITH p AS (SELECT *, {D.strip("coalesce(section_id, '') || '. ' || coalesce(title, '')")} AS h, nullif({D.strip("coalesce(chapter, '')")}, '') AS ch FROM tek17_dibk),
c AS (SELECT *, last_value(ch IGNORE NULLS) OVER (PARTITION BY root_print_url, sha256 ORDER BY _ord ROWS UNBOUNDED PRECEDING) AS carried, regexp_extract(h, '{_ID_SQL}', 1) AS num,
    {D.clean('reg_text')} AS reg, {D.clean('guidance_text')} AS gui FROM p)
SELECT concat_ws('#', root_print_url, sha256) AS path, carried AS chapter, '§ ' || num AS section_id, {D.strip(f"regexp_replace(h, '^{_ID_SQL}{D.WS}*[.–:-]?{D.WS}*', '')")} AS title,
    reg AS reg_text, CASE WHEN gui <> '' THEN 'Veiledning' || chr(10) || gui ELSE '' END AS guidance_text FROM c WHERE starts_with(h, '§') AND num <> ''""")
def html_provisions(spark, folder):
    """Provisions parsed back from pages that are made of provisions."""
    return H.provisions_of(H.page_blocks(_pages(spark, folder))).select("path", "chapter", "section_id", "title", "reg_text", "guidance_text")


_CANONICAL = "regexp_replace(regexp_replace(regexp_replace({0}, '[?#].*$', ''), ';[^/;]*$', ''), '/+$', '')"


@CATALOGUE.query("provision_records", f"""
WITH found AS ({CATALOGUE.oracles["html_provisions"]}),
s AS (SELECT concat_ws('#', root_print_url, sha256) AS path, root_print_url, sha256, max(final_url) AS final_url, max(downloaded_at) AS downloaded_at FROM tek17_dibk GROUP BY root_print_url, sha256)
SELECT 'dibk' AS source, 'provision' AS doc_type, root_print_url, final_url, {_CANONICAL.format("coalesce(nullif(final_url, ''), root_print_url)")} AS canonical_root_print_url, downloaded_at, path AS source_path, sha256,
    chapter, section_id, title, reg_text, guidance_text, concat_ws(chr(10) || chr(10), nullif(reg_text, ''), nullif(guidance_text, '')) AS full_text FROM found JOIN s USING (path)""")
def provision_records(spark, folder):
    """The fourteen columns of the provisions file."""
    pages = _pages(spark, folder).withColumnRenamed("path", "source_path")
    snapshots = table(spark, folder, "tek17_dibk").groupBy(F.col("root_print_url").alias("url"), "sha256").agg(F.max("final_url").alias("final_url"), F.max("downloaded_at").alias("downloaded_at"))
    snapshots = snapshots.withColumn("source_path", F.concat_ws("#", "url", "sha256"))
    return H.provision_records(H.provisions_of(H.page_blocks(pages, "source_path"), "source_path"), snapshots).drop("pos")


@CATALOGUE.query("chapter_carry_forward", """
SELECT root_print_url, sha256, _ord, last_value(chapter IGNORE NULLS) OVER (PARTITION BY root_print_url, sha256 ORDER BY _ord ROWS UNBOUNDED PRECEDING) AS carried FROM tek17_dibk""")
def chapter_carry_forward(spark, folder):
    rows = table(spark, folder, "tek17_dibk").select("root_print_url", "sha256", "_ord", "chapter")
    return H.carry_forward(rows, "chapter", "_ord", "root_print_url", "sha256", out="carried").drop("chapter")


_DOCS = f"""docs AS (
SELECT _ord AS ord, 'regulation' AS text_type, coalesce(section_id, 'unknown') || ' – ' || coalesce(title, '') || chr(10) || '(Forskriftstekst)' || chr(10) || chr(10) || {D.strip("coalesce(reg_text, '')")} AS text FROM tek17_dibk WHERE {D.strip("coalesce(reg_text, '')")} <> ''
UNION ALL SELECT _ord, 'guidance', coalesce(section_id, 'unknown') || ' – ' || coalesce(title, '') || chr(10) || '(Veiledning)' || chr(10) || chr(10) || {D.strip("coalesce(guidance_text, '')")} FROM tek17_dibk WHERE {D.strip("coalesce(guidance_text, '')")} <> '')"""


@CATALOGUE.query("unpivot_documents", f"WITH {_DOCS} SELECT ord, text_type, md5(text) AS text_md5 FROM docs")
def unpivot_documents(spark, folder):
    return C.documents_of(table(spark, folder, "tek17_dibk")).select("ord", "text_type", F.md5("text").alias("text_md5"))


@CATALOGUE.query("header_body", """
SELECT _ord, md5(CASE WHEN at > 0 THEN text[1:at + 1] ELSE '' END) AS header_md5, md5(CASE WHEN at > 0 THEN text[at + 2:] ELSE text END) AS body_md5
FROM (SELECT _ord, coalesce(text, '') AS text, instr(coalesce(text, ''), chr(10) || chr(10)) AS at FROM tek17_chunks)""".replace(" at ", " pos ").replace("at > 0", "pos > 0").replace("at + 1", "pos + 1").replace("at + 2", "pos + 2").replace("AS at", "AS pos"))
def header_body(spark, folder):
    h, b = C.header_and_body(T.text(F.col("text")))
    return table(spark, folder, "tek17_chunks").select("_ord", F.md5(h).alias("header_md5"), F.md5(b).alias("body_md5"))


@CATALOGUE.query("structural_units", f"""
WITH l AS (SELECT _ord, list_filter(list_transform(regexp_split_to_array(coalesce(guidance_text, ''), '\\r\\n|[\\n\\r]'), lambda z: {D.strip('z')}), lambda z: z <> '') AS lines FROM tek17_dibk),
x AS (SELECT _ord, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
u AS (SELECT *, sum(CASE WHEN i = 1 OR regexp_matches(line, '^(\\(\\d+\\)|[a-zæøåA-ZÆØÅ]\\)|\\d+\\)|[-–•])\\s+') THEN 1 ELSE 0 END) OVER (PARTITION BY _ord ORDER BY i) AS unit FROM x),
g AS (SELECT _ord, n, max(unit) AS units FROM u GROUP BY _ord, n),
j AS (SELECT u._ord, CASE WHEN g.n >= 8 AND g.units >= g.n - 1 THEN 1 ELSE u.unit END AS unit, u.line, u.i FROM u JOIN g ON u._ord = g._ord)
SELECT _ord, unit::BIGINT AS unit, md5(string_agg(line, chr(10) ORDER BY i)) AS unit_md5 FROM j GROUP BY _ord, unit""")
def structural_units(spark, folder):
    rows = table(spark, folder, "tek17_dibk").select("_ord", F.posexplode(C.structural_units(F.col("guidance_text"))).alias("unit", "text"))
    return rows.select("_ord", (F.col("unit") + 1).cast("bigint").alias("unit"), F.md5("text").alias("unit_md5"))


_PACK = f"""WITH RECURSIVE {_DOCS},
b AS (SELECT ord, text_type, text[1:instr(text, chr(10) || chr(10)) + 1] AS header, text[instr(text, chr(10) || chr(10)) + 2:] AS body FROM docs),
l AS (SELECT ord, text_type, header, list_filter(list_transform(regexp_split_to_array(body, '\\r\\n|[\\n\\r]'), lambda z: {D.strip('z')}), lambda z: z <> '') AS lines FROM b),
x AS (SELECT ord, text_type, header, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
m AS (SELECT *, sum(CASE WHEN i = 1 OR regexp_matches(line, '^(\\(\\d+\\)|[a-zæøåA-ZÆØÅ]\\)|\\d+\\)|[-–•])\\s+') THEN 1 ELSE 0 END) OVER (PARTITION BY ord, text_type ORDER BY i) AS unit FROM x),
g AS (SELECT ord, text_type, max(unit) AS units FROM m GROUP BY ALL),
j AS (SELECT m.ord, m.text_type, header, CASE WHEN n >= 8 AND units >= n - 1 THEN 1 ELSE unit END AS i, string_agg(line, chr(10) ORDER BY m.i) AS u FROM m JOIN g USING (ord, text_type) GROUP BY ALL),
u AS (SELECT *, length(header) AS h, length(u) AS len, max(i) OVER (PARTITION BY ord, text_type) AS n, sum(length(u) + 2) OVER (PARTITION BY ord, text_type ORDER BY i) AS c FROM j),
e AS (SELECT s.ord, s.text_type, s.i AS a, s.n, s.len > greatest(1, 800 - s.h) AS big, CASE WHEN s.len > greatest(1, 800 - s.h) THEN s.i ELSE max(t.i) FILTER (WHERE t.i = s.i OR s.h + t.c - (s.c - s.len - 2) - 2 <= 800) END AS z
    FROM u s JOIN u t ON s.ord = t.ord AND s.text_type = t.text_type AND t.i >= s.i GROUP BY s.ord, s.text_type, s.i, s.n, s.h, s.len, s.c),
w AS (SELECT e.ord, e.text_type, e.a, e.n, e.big, e.z, max(t.i) FILTER (WHERE t.i > e.a AND t.i <= e.z AND l.c - (t.c - t.len - 2) >= 200) AS back
    FROM e JOIN u l ON e.ord = l.ord AND e.text_type = l.text_type AND e.z = l.i JOIN u t ON e.ord = t.ord AND e.text_type = t.text_type GROUP BY e.ord, e.text_type, e.a, e.n, e.big, e.z),
step AS (SELECT *, CASE WHEN big THEN a + 1 WHEN z >= n THEN NULL ELSE coalesce(back, greatest(a + 1, z)) END AS following FROM w),
chain AS (SELECT ord, text_type, 1::HUGEINT AS a FROM step WHERE a = 1 UNION SELECT c.ord, c.text_type, s.following FROM chain c JOIN step s ON c.ord = s.ord AND c.text_type = s.text_type AND c.a = s.a WHERE s.following IS NOT NULL AND s.following <= s.n)
SELECT c.ord, c.text_type, c.a::BIGINT AS para_start, s.z::BIGINT AS para_end, CASE WHEN NOT s.big THEN md5(min(u.header) || string_agg(u.u, chr(10) || chr(10) ORDER BY u.i)) END AS text_md5
FROM chain c JOIN step s ON c.ord = s.ord AND c.text_type = s.text_type AND c.a = s.a JOIN u ON u.ord = c.ord AND u.text_type = c.text_type AND u.i BETWEEN c.a AND s.z GROUP BY c.ord, c.text_type, c.a, s.z, s.big"""


@CATALOGUE.query("pack_chunks", _PACK)
def pack_chunks(spark, folder):
    """Which units each chunk holds, and its text's hash; the parts of an oversized unit are one row without hash, as their cuts are our own."""
    docs = C.documents_of(table(spark, folder, "tek17_dibk"))
    chunks = C.chunk_documents(docs).select("ord", "metadata.text_type", F.col("metadata.para_start").cast("bigint").alias("para_start"), F.col("metadata.para_end").cast("bigint").alias("para_end"), "text")
    header, body = C.header_and_body(F.col("text"))
    one = lambda us: F.filter(F.transform(us, lambda u, i: F.struct((i + 1).cast("bigint").alias("unit"), F.length(u).alias("len"))), lambda u: u["len"] > F.lit(C.SIZE) - F.length(header))
    big = docs.select("ord", "text_type", F.explode(one(C.structural_units(body))).alias("b")).select("ord", "text_type", F.col("b.unit").alias("para_start"), F.lit(True).alias("big"))
    rows = chunks.join(big, ["ord", "text_type", "para_start"], "left")
    return rows.select("ord", "text_type", "para_start", "para_end", F.when(F.col("big").isNull(), F.md5("text")).alias("text_md5")).distinct()


_ID = """substr(sha256(coalesce(metadata.section_id, '') || '::' || coalesce(metadata.text_type, '') || '::' || coalesce(metadata.para_start::VARCHAR, '') || '-' || coalesce(metadata.para_end::VARCHAR, '') || '::' || sha256(coalesce(text, ''))), 1, 24)"""


@CATALOGUE.query("stable_chunk_id", f"SELECT _ord, {_ID} AS id FROM tek17_chunks")
def stable_chunk_id(spark, folder):
    return table(spark, folder, "tek17_chunks").select("_ord", T.stable_chunk_id(F.col("text"), F.col("metadata")).alias("id"))


@CATALOGUE.query("upsert_last_wins", f"SELECT id, max(_ord) AS _ord FROM (SELECT _ord, {_ID} AS id FROM tek17_chunks) GROUP BY id")
def upsert_last_wins(spark, folder):
    rows = table(spark, folder, "tek17_chunks").select("_ord", T.stable_chunk_id(F.col("text"), F.col("metadata")).alias("id"))
    return last_wins(rows, "id").select("id", "_ord")


@CATALOGUE.query("collection_refresh", f"""WITH c AS (SELECT {_ID} AS id, _ord, text, metadata FROM tek17_chunks), l AS (SELECT id, max(_ord) AS _ord FROM c GROUP BY id)
SELECT id, md5(text) AS document_md5, metadata.section_id AS section_id, 64 AS dim FROM c JOIN l USING (id, _ord)""")
def collection_refresh(spark, folder):
    """Chunks embedded offline and written as a collection, the last of each id; opened again."""
    from kvist.providers import embed_chunks, hashing_embedder

    path = scratch(spark)
    S.refresh(embed_chunks(table(spark, folder, "tek17_chunks"), hashing_embedder()), path)
    return S.open_collection(spark, path).select("id", F.md5("document").alias("document_md5"), "metadata.section_id", F.size("embedding").alias("dim"))


@CATALOGUE.query("embed_questions", """
WITH w AS (SELECT _ord, unnest(regexp_extract_all(lower(question), '[0-9a-zæøå]+')) AS w FROM tek17_eval_questions),
h AS (SELECT _ord, ('0x' || substr(md5(w), 15, 2))::BIGINT % 64 AS dim, CASE WHEN ('0x' || substr(md5(w), 1, 1))::BIGINT >= 8 THEN 1 ELSE -1 END AS sign FROM w),
s AS (SELECT _ord, dim, sum(sign)::DOUBLE AS s FROM h GROUP BY _ord, dim)
SELECT _ord, dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY _ord)), 3) AS value FROM s WHERE s <> 0""")
def embed_questions(spark, folder):
    """The offline vectors of all questions, as their coordinates that aren't zero."""
    from kvist.providers import embed_column, embedder

    rows = embed_column(table(spark, folder, "tek17_eval_questions").select("_ord", "question"), "question", embedder("offline"))
    rows = rows.select("_ord", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0")
    return rows.select("_ord", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 3).alias("value"))


@CATALOGUE.query("store_fingerprint", S.fingerprint_sql("tek17_eval_questions", "sha256(concat_ws(chr(31), coalesce('{\"id\":' || to_json(id) || '}', '{}'), coalesce('{\"question_type\":' || to_json(question_type) || '}', '{}')))"))
def store_fingerprint(spark, folder):
    return S.fingerprint(table(spark, folder, "tek17_eval_questions").select("id", "question_type"))


@CATALOGUE.query("collection_fingerprint")
def collection_fingerprint(spark, folder):
    """The vector collection's fingerprint over all its columns; DuckDB doesn't render arrays of floats and structs alike."""
    return S.fingerprint(table(spark, folder, "chroma_collection"))


@CATALOGUE.query("section_dedupe", f"""SELECT section_id, min(_ord) AS _ord FROM (SELECT _ord, {D.strip("coalesce(section_id, '')")} AS section_id, {D.strip("coalesce(title, '')")} AS title FROM tek17_dibk) WHERE section_id <> '' AND title <> '' GROUP BY section_id""")
def section_dedupe(spark, folder):
    return Q.sections(table(spark, folder, "tek17_dibk")).select("section_id", "_ord")


def _keywords_sql(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    for p in (r"kapittel\s+\d+\b", r"\bns\s*\d+[\-0-9:]*\b"):
        t = f"regexp_replace({t}, '{p if p[0] == chr(92) else chr(92) + 'b' + p}', ' ', 'g')"
    t = f"regexp_replace({t}, '[^0-9a-zA-ZæøåÆØÅ%\\- ]+', ' ', 'g')"
    stop = ", ".join(f"'{w}'" for w in T.KEYWORD_STOPWORDS)
    words = f"list_transform(string_split_regex({t}, ' +'), lambda z: regexp_replace(z, '^[- ]+|[- ]+$', '', 'g'))"
    good = f"list_filter({words}, lambda z: length(z) >= 4 AND NOT list_contains([{stop}], z) AND NOT regexp_full_match(z, '[0-9]+'))"
    return f"(SELECT list(w ORDER BY i)[1:6] FROM (SELECT w, min(i) AS i FROM (SELECT unnest(g) AS w, generate_subscripts(g, 1) AS i FROM (SELECT {good} AS g)) GROUP BY w))"


@CATALOGUE.query("keyword_extract", f"SELECT _ord, coalesce(array_to_string({_keywords_sql('reg_text')}, ' '), '') AS keywords FROM tek17_dibk")
def keyword_extract(spark, folder):
    return table(spark, folder, "tek17_dibk").select("_ord", F.array_join(T.keywords(F.col("reg_text")), " ").alias("keywords"))


@CATALOGUE.query("section_draw", f"""
SELECT section_id, rank FROM (SELECT section_id, row_number() OVER (ORDER BY md5('17:' || section_id), section_id) AS rank FROM (
    SELECT DISTINCT {D.strip("coalesce(section_id, '')")} AS section_id FROM tek17_dibk WHERE {D.strip("coalesce(section_id, '')")} <> '' AND {D.strip("coalesce(title, '')")} <> '')) WHERE rank <= 80""")
def section_draw(spark, folder):
    """The seeded draw of 80 sections; a sampling operator, so the limit is its feature."""
    from pyspark.sql import Window as W

    key = Q.draw_key(F.col("section_id"), 17)
    drawn = Q.sections(table(spark, folder, "tek17_dibk")).select("section_id", key.alias("k")).orderBy("k", "section_id").limit(80)
    return drawn.select("section_id", F.row_number().over(W.orderBy("k", "section_id")).cast("bigint").alias("rank"))


@CATALOGUE.query("question_items")
def question_items(spark, folder):
    return Q.question_set(table(spark, folder, "tek17_dibk"), multi_share=0.25)


def _cut_sql(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p.replace('(?U)', '')}', ' ', 'g')"
    return x


def _topic_sql(x: str) -> str:
    x = f"lower({x})"
    for word, plain in T.TITLE_SYNONYMS.items():
        x = f"regexp_replace({x}, '\\b{word}\\b', '{plain}', 'g')"
    return f"regexp_replace(replace({x}, 'krav til', 'krav for'), '^[ .–-]+|[ .–-]+$', '', 'g')"


_TITLE = f"trim({_cut_sql(D.strip(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')'), T.TITLE_CUTS)})"


@CATALOGUE.query("title_topics", f"""WITH t AS (SELECT _ord, section_id, {_TITLE} AS title FROM tek17_dibk), p AS (SELECT *, {_topic_sql('title')} AS topic FROM t)
SELECT _ord, title, CASE WHEN topic = '' THEN 'dette temaet' ELSE topic || '|' || topic || ' i et byggprosjekt' || CASE WHEN starts_with(topic, 'krav') THEN '' ELSE '|krav knyttet til ' || topic END END AS variants,
    CASE WHEN starts_with(section_id, '§ 1-') OR starts_with(section_id, '§ 2-') THEN 'easy' ELSE 'medium' END AS difficulty FROM p""")
def title_topics(spark, folder):
    rows = table(spark, folder, "tek17_dibk")
    return rows.select("_ord", T.clean_title(F.col("title")).alias("title"), F.array_join(T.topic_variants(F.col("title")), "|").alias("variants"), T.difficulty(F.col("section_id")).alias("difficulty"))


def _array_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@CATALOGUE.query("section_questions", f"""
WITH s AS (SELECT {D.strip("coalesce(section_id, '')")} AS section_id, {D.strip("coalesce(title, '')")} AS title, _ord FROM tek17_dibk),
f AS (SELECT section_id, arg_min(title, _ord) AS title, min(_ord) AS _ord FROM s WHERE section_id <> '' AND title <> '' GROUP BY section_id)
SELECT 'auto_in_single_' || CASE WHEN _ord < 1000 THEN lpad(_ord::VARCHAR, 3, '0') ELSE _ord::VARCHAR END AS id, 'in_scope_single' AS question_type, replace(replace({_array_sql(Q.TITLES)}[_ord % {len(Q.TITLES)} + 1], '{{0}}', section_id), '{{1}}', lower(title)) AS question,
    section_id AS target, CASE WHEN starts_with(section_id, '§ 1-') OR starts_with(section_id, '§ 2-') THEN 'easy' ELSE 'medium' END AS difficulty, false AS should_refuse FROM f""")
def section_questions(spark, folder):
    """A question about each section, by its title; numbered by the section's line."""
    rows = Q.sections(table(spark, folder, "tek17_dibk")).withColumn("idx", F.col("_ord"))
    return Q.single_items(rows, "title").select("id", "question_type", "question", F.array_join("target_sections", "|").alias("target"), "difficulty", "should_refuse")


def _pair_sql(k: str) -> str:
    return f"CASE WHEN len({k}) >= 2 THEN {k}[i % len({k}) + 1] || ' ' || {k}[(i + 1) % len({k}) + 1] WHEN len({k}) = 1 THEN {k}[1] END"


_SCENARIO = "CASE " + " ".join(f"WHEN regexp_matches(lower(topic), '{p}') THEN replace({_array_sql(texts)}[i % {len(texts)} + 1], '{{}}', topic)" for p, texts in Q.SCENARIOS) + " END"


@CATALOGUE.query("section_topics", f"""
WITH s AS (SELECT {D.strip("coalesce(section_id, '')")} AS section_id, {D.strip("coalesce(title, '')")} AS title, {D.strip("coalesce(reg_text, '')")} AS reg, {D.strip("coalesce(guidance_text, '')")} AS gui, _ord FROM tek17_dibk),
f AS (SELECT section_id, arg_min(title, _ord) AS title, arg_min(reg, _ord) AS reg, arg_min(gui, _ord) AS gui, min(_ord) AS i FROM s WHERE section_id <> '' AND title <> '' GROUP BY section_id),
k AS (SELECT *, {_keywords_sql('reg')} AS kr, {_keywords_sql('gui')} AS kg, {_topic_sql(_TITLE)} AS plain FROM f),
v AS (SELECT *, CASE WHEN plain = '' THEN ['dette temaet'] WHEN starts_with(plain, 'krav') THEN [plain, plain || ' i et byggprosjekt'] ELSE [plain, plain || ' i et byggprosjekt', 'krav knyttet til ' || plain] END AS phrases FROM k),
t AS (SELECT *, coalesce({_pair_sql('kr')}, {_pair_sql('kg')}, phrases[i % len(phrases) + 1]) AS topic FROM v)
SELECT section_id, topic, {_SCENARIO} AS question FROM t""")
def section_topics(spark, folder):
    """Each section's topic, and the question that its scenario makes of it; numbered by the section's line."""
    rows = Q.sections(table(spark, folder, "tek17_dibk")).withColumn("topic", Q.topic(F.col("_ord")))
    return rows.select("section_id", "topic", Q.scenario(F.col("topic"), F.col("_ord")).alias("question"))


@CATALOGUE.query("section_groups", f"""
WITH s AS (SELECT {D.strip("coalesce(section_id, '')")} AS section_id, {D.strip("coalesce(title, '')")} AS title, {D.strip("coalesce(chapter, '')")} AS chapter, _ord FROM tek17_dibk),
f AS (SELECT section_id, coalesce(nullif(arg_min(chapter, _ord), ''), '(no_chapter)') AS ch FROM s WHERE section_id <> '' AND title <> '' GROUP BY section_id),
z AS (SELECT ch, count(*) AS size FROM f GROUP BY ch HAVING count(*) >= 2),
c AS (SELECT i, arg_min(struct_pack(ch, size), md5('17:' || i || ':' || ch)) AS c FROM z, (SELECT unnest(range(1, 41)) AS i) GROUP BY i),
n AS (SELECT i, c.ch AS ch, least(c.size, 2 + (substr(md5('17:' || i), 1, 1) >= '8')::INT) AS k FROM c),
m AS (SELECT i, k, section_id, row_number() OVER (PARTITION BY i ORDER BY md5('17:' || i || ':' || section_id)) AS rn FROM n JOIN f USING (ch))
SELECT i AS idx, string_agg(section_id, '|' ORDER BY rn) AS sections FROM m WHERE rn <= k GROUP BY i""")
def section_groups(spark, folder):
    """Forty draws of two or three sections of one chapter; how many is a setting of the operator."""
    groups = Q.multi_groups(Q.sections(table(spark, folder, "tek17_dibk")), 40, 17)
    return groups.select("idx", F.array_join(F.transform("members", lambda x: x["section_id"]), "|").alias("sections"))


_REFUSE = " UNION ALL ".join(f"""SELECT 'auto_ref_{kind}_' || lpad(i::VARCHAR, 3, '0') AS id, {_array_sql(Q.WRAPPERS)}[i % {len(Q.WRAPPERS)} + 1] || {_array_sql(texts)}[i % {len(texts)} + 1] AS question, '{kind}' AS refusal_type,
    CASE WHEN i % 3 = 0 THEN 'easy' ELSE 'medium' END AS difficulty, true AS should_refuse FROM (SELECT unnest(range(1, 41)) AS i)""" for kind, texts in (("out_of_scope", Q.OUT_OF_SCOPE), ("in_domain_missing_context", Q.MISSING_CONTEXT)))


@CATALOGUE.query("refusal_items", _REFUSE)
def refusal_items(spark, folder):
    """Forty items to be refused of either kind; how many is a setting of the operator."""
    both = Q.refusal_items(spark, 40, "out_of_scope").unionByName(Q.refusal_items(spark, 40, "in_domain_missing_context"))
    return both.select("id", "question", "refusal_type", "difficulty", "should_refuse")


@CATALOGUE.query("manifest_stream", CATALOGUE.oracles["latest_valid_snapshot"])
def manifest_stream(spark, folder):
    """The latest valid snapshot of each url, kept by a stream over the manifest's files."""
    from kvist.streaming.snapshots import latest_by_stream

    return latest_by_stream(spark, materialize(table(spark, folder, "manifest")))
