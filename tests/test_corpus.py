"""Golden values and properties of chunking, retrieval, metrics, HTML and records."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from kvist.functions import text as T
from kvist.functions.metrics import refusal_metrics, wilson
from kvist.operators import retrieval as R
from kvist.operators.chunking import chunk_documents, documents_of, pack_units, split_large
from kvist.operators.sweep import csv_list, file_safe, grid
from kvist.sources.html import html_blocks, page_blocks, provisions_of

H = "h" * 10
PACKED = {
    "no overlap": ([8] * 5, 30, 0, [(28, 1, 2), (28, 3, 4), (18, 5, 5)]), "overlap": ([8] * 5, 30, 5, [(28, 1, 2), (28, 2, 3), (28, 3, 4), (28, 4, 5)]),
    "overlap over chunk": ([8] * 5, 40, 100, [(38, 1, 3), (38, 3, 5)]), "exact fit": ([9, 9], 30, 0, [(30, 1, 2)]), "one over": ([9, 10], 30, 0, [(19, 1, 1), (20, 2, 2)]),
}


@pytest.mark.parametrize("case", PACKED)
def test_packing(case):
    lengths, size, overlap, want = PACKED[case]
    assert [(len(c), a, b) for c, a, b in pack_units(H, ["x" * n for n in lengths], size, overlap)] == want


def test_packing_oversized_and_properties():
    got = pack_units(H, ["a" * 8, "b " * 25, "c" * 8], 30, 5)
    assert (got[0][1:], got[-1][1:]) == ((1, 1), (3, 3)) and all(x[1:] == (2, 2) and len(x[0]) <= 30 for x in got[1:-1])
    rng = random.Random(2)
    for _ in range(300):
        units = ["".join(rng.choice("ab .\n") for _ in range(rng.randint(1, 90))).strip() or "u" for _ in range(rng.randint(1, 12))]
        out = pack_units(H, units, 60, rng.choice([0, 10, 50]))
        assert {u for _, a, b in out for u in range(a, b + 1)} == set(range(1, len(units) + 1))
        assert all(len(c) <= 60 for c, _, _ in out) and all(x[1] <= y[1] for x, y in zip(out, out[1:]))


def test_split_large_keeps_words():
    body = " ".join(f"ord{i}" for i in range(400))
    parts = split_large(body, 100, 20)
    assert all(len(p) <= 100 for p in parts) and {w for p in parts for w in p.split()} == set(body.split())


def test_bm25_golden(spark):
    docs = spark.createDataFrame([(1, "Krav til trapp"), (2, "Trapp og rampe trapp"), (3, "Lyd"), (4, ""), (5, None)], "o int, t string").filter("o < 5")
    q = spark.createDataFrame([("q", "trapp trapp rampe?"), ("e", None)], "id string, q string")
    rows = R.sparse_top_k(q, docs, 6, "id", "q", "o", "t").orderBy("rank").collect()
    assert [(r["ord"], round(r["score"], 12), round(r["distance"], 6)) for r in rows] == [(2, 1.579674375257, 0.0), (1, 0.56583443311, 0.641803)]


@pytest.mark.parametrize("alpha,want", [(0.0, [("k2", 0), ("k3", 0.4), ("k1", 1)]), (0.5, [("k2", 0.1), ("k1", 0.5), ("k3", 0.7)]), (1.0, [("k1", 0), ("k2", 0.2), ("k3", 1)])])
def test_fusion_golden(spark, alpha, want):
    d = spark.createDataFrame([("q", "k1", 0.2), ("q", "k2", 0.5), ("q", "k2", 0.9)], "qid string, key string, distance double")
    s = spark.createDataFrame([("q", "k2", 0.0), ("q", "k3", 0.4)], "qid string, key string, distance double")
    got = [(r["key"], round(r["distance"], 9)) for r in R.fuse(d, s, 3, alpha).orderBy("rank").collect()]
    assert got == [(k, pytest.approx(v)) for k, v in want]


def test_dense_edges(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0]), ("e", [])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = [(r["qid"], r["id"], r["rank"]) for r in R.dense_top_k(df, df, 2, "id", "v", "id", "v").orderBy("qid", "rank").collect()]
    assert got == [("a", "a", 1), ("a", "b", 2), ("b", "a", 1), ("b", "b", 2), ("c", "c", 1), ("c", "a", 2), ("s", "s", 1)]


def test_methods():
    assert R.normalize_method(" Sparce ") == "sparse" and R.normalize_method(None) == "dense"
    with pytest.raises(ValueError):
        R.normalize_method("nearest")


def test_metrics_golden(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in refusal_metrics(*(F.lit(x) for x in (9, 49, 299, 42))).items()]).first()
    want = {"accuracy": 0.7719298, "precision": 0.1551724, "recall": 0.1764706, "specificity": 0.8591954, "f1": 0.1651376, "balanced_accuracy": 0.5178330, "mcc": 0.0337861, "refusal_rate_pred": 0.1453634, "refusal_rate_true": 0.1278195}
    assert {k: round(v, 7) for k, v in row.asDict().items()} == want
    for (k, n), (lo, hi) in {(0, 0): (0, 0), (0, 10): (0, 0.277540), (10, 10): (0.722460, 1), (20, 33): (0.436831, 0.753171)}.items():
        low, high = wilson(F.lit(k), F.lit(n))
        r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
        assert math.isclose(r["a"], lo, abs_tol=1e-6) and math.isclose(r["b"], hi, abs_tol=1e-6)


PAGE = """<html><body><nav><h2 class="big-header">§ 9-9. Utenfor</h2></nav><main class="print-document-content">
<div class="print-chapter-content"><div class="block-header">Kapittel 1 <b>Felles</b></div>
<h2 class="big-header">§ 1-2. Tittel &amp; mer</h2><p>mellom</p><section class="section-big x"><p>Første<p>Første<p>andre<br>Første
<ul class="guidance-text"><li class="accordion-navigation"><a class="accordion-title">Til ledd</a><div class="content"><b>Råd</b></div>
<li class="accordion-navigation"><div class="content">Uten navn</div></li><li class="accordion-navigation"><a class="accordion-title">Tom</a><div class="content"> </div></li></ul></section>
<h2 class="big-header">Innledning</h2><section class="section-big">nei</section>
<h2 class="big-header">§ X</h2><section class="section-big">nei</section><h2 class="big-header">§ 1-3 Uten kropp</h2><h2 class="big-header">§ 12-3a – Med</h2><section class="section-big">ja</section></div>
<div class="print-chapter-content"><h2 class="big-header">§ 2-1 Neste</h2><section class="section-big"><script>x</script>to</section></div></main>"""


def test_html(spark):
    df = provisions_of(page_blocks(spark.createDataFrame([("p", PAGE), ("e", ""), ("n", None)], "path string, content string")))
    rows = [tuple(r)[2:7] for r in df.orderBy("pos").collect()]
    assert rows == [
        ("Kapittel 1 Felles", "§ 1-2", "Tittel & mer", "Første\nandre\nFørste", "Til ledd\nRåd\n\nVeiledning\nUten navn"),
        ("Kapittel 1 Felles", "§ 12-3a", "Med", "ja", ""), ("Kapittel 1 Felles", "§ 2-1", "Neste", "to", ""),
    ]
    empty = provisions_of(page_blocks(spark.createDataFrame([("p", "<div class='print-chapter-content'><h2 class='big-header'>§ 1-1 A</h2><section class='section-big'></section></div>")], "path string, content string")))
    assert [tuple(r)[3:] for r in empty.collect()] == [("§ 1-1", "A", "", "", "")]
    assert html_blocks(b"") == []
    block = "<div class='print-chapter-content'><h2 class='big-header'>§ 1-1 A</h2><section class='section-big'>x</section></div>"
    assert len(html_blocks(f"{block}<main>{block}</main>{block}")) == 3 and len(html_blocks(block * 2)) == 6
    assert len(html_blocks(f"<main>{block}<div class='print-document-content'>{block}</div></main>")) == 3


def test_documents_and_chunks(spark):
    rows = [(1, "s", "§ 1-1", "T", "K", "(1) a\n(2) b", "  "), (2, None, None, None, None, None, "råd"), (3, "s", "§", "t", None, "", None)]
    p = spark.createDataFrame(rows, "_ord bigint, source string, section_id string, title string, chapter string, reg_text string, guidance_text string")
    docs = documents_of(p)
    assert sorted((r["ord"], r["text_type"], r["text"]) for r in docs.collect()) == [(1, "regulation", "§ 1-1 – T\n(Forskriftstekst)\n\n(1) a\n(2) b"), (2, "guidance", "unknown – \n(Veiledning)\n\nråd")]
    got = chunk_documents(docs).orderBy("ord").collect()
    assert [(r["metadata"]["para_start"], r["metadata"]["para_end"], r["text"][-12:]) for r in got][0] == (1, 2, "(1) a\n\n(2) b")


def test_scalar_edges(spark):
    df = spark.createDataFrame([("  a b ",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(T.strip(F.col("s"))).collect()] == ["a b", "", None]
    one = lambda c: df.limit(1).select(c).first()[0]
    assert one(T.canonical_url(F.lit("https://a.b/c/d;p=1/?q#f"))) == "https://a.b/c/d;p=1"
    assert one(T.relocate_path(F.lit("/x/data/y/data/z"), "/r")) == "/r/data/y/data/z" and one(T.relocate_path(F.lit("/x/y"), "/r")) == "/x/y"
    assert one(T.section_set(F.array(F.lit("8-5"), F.lit("§ 8-5 "), F.lit(" "), F.lit(None).cast("string"), F.lit("§")))) == ["", "8-5"]
    assert one(T.classify_refusal(F.lit(None).cast("string"))) is True and one(T.has_refusal_tag(F.lit("svar: KAN_IKKE_SVARE"))) is True
    assert one(T.keywords(F.lit("Skal dør i § 1-2 og kapittel 3 med trapper, trapper 1234"))) == ["trapper"]


def test_grid():
    runs = grid(2, ["baseline"], [6], ["dense", "hybrid"], [0.25, 0.75], [0.0])
    assert len(runs) == 6 and [r["hybrid_alpha"] for r in runs if r["retrieval_method"] == "dense"] == [0.25, 0.25]
    assert csv_list(" a, ,b ") == ["a", "b"] and csv_list("1,2", int) == [1, 2] and file_safe("a/b c:d") == "a-b-c-d"


def test_packing_independent_of_partitions(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/tek17_dibk.parquet")
    runs = [sorted(map(str, chunk_documents(documents_of(p.repartition(n))).collect())) for n in (1, 8)]
    assert runs[0] == runs[1] and json.dumps(runs[0][0])


def test_collection_fingerprint_sees_every_column(spark, tmp_path):
    from kvist.plans.corpus import CATALOGUE

    df = spark.read.parquet("/root/testdata/sf0.001/chroma_collection.parquet")
    one = F.col("id") == df.agg(F.max("id")).first()[0]
    changed = {
        "same": F.col("id"), "id": F.when(one, F.lit("x")).otherwise(F.col("id")), "embedding": F.when(one, F.array_append("embedding", F.lit(0.5).cast("float"))).otherwise(F.col("embedding")),
        "document": F.when(one, F.concat(F.coalesce("document", F.lit("")), F.lit("."))).otherwise(F.col("document")), "metadata": F.when(one, F.col("metadata").withField("para_end", F.lit(-1))).otherwise(F.col("metadata")),
    }
    found = {}
    for name, column in changed.items():
        df.withColumn("id" if name == "same" else name, column).repartition(3).write.parquet(f"{tmp_path}/{name}/chroma_collection.parquet")
        found[name] = tuple(CATALOGUE.queries["collection_fingerprint"](spark, f"{tmp_path}/{name}").first())
    assert {n for n, _ in found.values()} == {df.count()} and len({h for _, h in found.values()}) == len(changed)
    assert found["same"] == tuple(CATALOGUE.queries["collection_fingerprint"](spark, "/root/testdata/sf0.001").first())


def test_question_types_of_all_rows(spark, tmp_path):
    from kvist.plans.scoring import CATALOGUE

    rows = [(1, "a", " refusal ", False, ["1-1"]), (2, "b", "refusal", False, ["1-1"]), (3, "c_multi_1", "in_scope_single", None, None), (4, "d", None, True, ["1-1", "1-2"]), (5, None, " ", False, ["1-1", "1-2"]), (6, None, None, None, None)]
    spark.createDataFrame(rows, "_ord bigint, id string, question_type string, should_refuse boolean, target_sections array<string>").write.parquet(f"{tmp_path}/tek17_eval_questions.parquet")
    got = sorted(map(tuple, CATALOGUE.queries["question_types_all"](spark, str(tmp_path)).collect()))
    assert got == [(1, "refusal", "in_scope_single"), (2, "refusal", "in_scope_single"), (3, "in_scope_single", "in_scope_multi"), (4, "refusal", "refusal"), (5, "in_scope_multi", "in_scope_multi"), (6, "in_scope_single", "in_scope_single")]


def test_bm25_by_salts_and_by_index(spark, monkeypatch, tmp_path):
    """Query tokens beyond the broadcast's bound, tokens of all documents, an index that is kept for the same texts only."""
    docs = spark.createDataFrame([(i, " ".join(["og", f"w{i % 7}", f"x{i % 50}", "og"][: i % 5])) for i in range(300)], "o int, t string")
    asked = spark.createDataFrame([(i, f"og w{i} x{i} og ukjent") for i in range(20)], "q int, t string")
    score = lambda df: {(r["qid"], r["ord"]): round(r["score"], 9) for r in df.collect()}
    want = score(R.bm25_scores(asked, docs, "q", "t", "o", "t"))
    path = str(tmp_path / "index")
    assert R.ensure_index(docs, path, "o", "t") and not R.ensure_index(docs.repartition(3), path, "o", "t")
    assert score(R.index_scores(asked, path, "q", "t")) == want
    monkeypatch.setattr(R, "BROADCAST_LIMIT", -1)
    monkeypatch.setattr(R, "HEAVY", 10)
    assert score(R.bm25_scores(asked, docs, "q", "t", "o", "t")) == want == score(R.index_scores(asked, path, "q", "t"))
    assert R.ensure_index(docs.union(docs.limit(1).withColumn("o", F.lit(999))), path, "o", "t") and len(score(R.index_scores(asked, path, "q", "t"))) >= len(want)
    assert len(want) > 1000 and R.bm25_scores(asked, docs.limit(0), "q", "t", "o", "t").count() == 0 == R.bm25_scores(asked.limit(0), docs, "q", "t", "o", "t").count()


def test_dense_blocks_agree(spark, monkeypatch):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)] if i % 9 else ([float("nan")] * 8 if i % 2 else [1.0, None])) for i in range(120)], "id int, v array<double>")
    rows = lambda: sorted(map(tuple, R.dense_top_k(df, df, 3, "id", "v", "id", "v").select("qid", "id", "rank").collect()))
    whole = rows()
    monkeypatch.setattr(R, "BLOCK_FLOATS", 100)
    assert rows() == whole and len(whole) == 3 * sum(1 for i in range(120) if i % 9)


def test_bm25_best_of_blocks(spark, monkeypatch):
    """The k best equal all scores' first k, over several portions of queries, and what leaves the blocks isn't the product of both sides."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(["og", *rng.choices([f"w{x}" for x in range(40)], k=1 + i % 9)])) for i in range(2000)], "o int, t string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(["og", *rng.choices([f"w{x}" for x in range(40)], k=4)])) for i in range(40)], "q int, t string")
    scored = R.bm25_scores(asked, docs, "q", "t", "o", "t")
    want = sorted((r["qid"], r["rank"], r["ord"]) for r in R.best_first(scored, 5, F.col("score"), "ord").collect())
    found = lambda: sorted((r["qid"], r["rank"], r["ord"]) for r in R.sparse_top_k(asked, docs, 5, "q", "t", "o", "t").collect())
    assert scored.count() == 40 * 2000 and found() == want and R.bm25_scores(asked, docs, "q", "t", "o", "t", k=5).count() < 8000
    monkeypatch.setattr(R, "QUERY_TOKENS", 70)
    monkeypatch.setattr(R, "HEAVY", 20)
    assert found() == want


def test_bm25_of_repeated_keys(spark, tmp_path):
    """Documents of one key add their scores, and each counts in the statistics, as in SQL."""
    docs = spark.createDataFrame([(1, "trapp a"), (1, "trapp a"), (1, "trapp b c"), (2, "trapp"), (3, "lyd"), (None, "trapp trapp")], "o int, t string")
    asked = spark.createDataFrame([("q", "trapp lyd"), ("q", "lyd")], "id string, q string")
    from oracle import duck
    from kvist.plans.ranking import _bm25_sql

    docs.write.parquet(f"{tmp_path}/docs.parquet")
    asked.write.parquet(f"{tmp_path}/asked.parquet")
    _, want = duck(f"WITH {_bm25_sql('SELECT id AS qid, q FROM asked', 'SELECT o AS ord, t AS text FROM docs', 6)} SELECT qid, ord, round(score, 9) FROM sparse", str(tmp_path))
    got = [(r["qid"], r["ord"], round(r["score"], 9)) for r in R.sparse_top_k(asked, docs, 6, "id", "q", "o", "t").collect()]
    assert len(got) == 4 and sorted(got, key=str) == sorted(want, key=str)


def test_dense_by_small_pieces(spark, monkeypatch):
    """Vectors and queries are multiplied in pieces of bounded size, whose sizes change nothing; copies tie by id."""
    rng = random.Random(8)
    df = spark.createDataFrame([(i, [float(x) for x in rng.choices(range(-2, 3), k=4)]) for i in range(900)], "id int, v array<double>").repartition(2)
    asked = df.filter("id % 30 = 0")
    rows = lambda: sorted(map(tuple, R.dense_top_k(asked, df, 3, "id", "v", "id", "v").select("qid", "id", "rank").collect()))
    whole = rows()
    monkeypatch.setattr(R, "SCAN_ROWS", 300)
    monkeypatch.setattr(R, "SCAN_QUERIES", 7)
    assert rows() == whole and len(whole) == 3 * asked.filter("exists(v, x -> x <> 0)").count()


@pytest.mark.parametrize("query", ["chapter_filter", "sweep_alpha", "per_query_k"])
def test_queries_ask_blocks_for_their_best(spark, monkeypatch, query):
    """Each search says how many it wants, and what leaves the blocks of postings is far less than all that shares a token."""
    from kvist.plans import ranking

    asked, score = [], R.bm25_scores

    def noted(*args, **kinds):
        asked.append((args, kinds, score(*args, **kinds)))
        return asked[-1][2]

    monkeypatch.setattr(R, "bm25_scores", noted)
    ranking.CATALOGUE.queries[query](spark, "/root/testdata/sf0.01")
    (args, kinds, found), = asked
    whole = score(*args[:8]).count()
    assert whole > 3000 and found.count() < whole / 4


#: The searches whose found rows meet a table, which doesn't travel for them.
MEETING = ["context_assembly", "chapter_filter", "per_query_k", "hybrid_topk", "sweep_alpha", "retrieve_sparse", "retrieve_hybrid", "recall_at_k"]


@pytest.mark.parametrize("query", MEETING)
def test_found_rows_travel(spark, monkeypatch, query):
    """What was found is sent to the table's rows; where it is too much for that, a shuffle gives the same rows."""
    from kvist.plans import ranking

    run = lambda: ranking.CATALOGUE.queries[query](spark, "/root/testdata/sf0.01")
    rows = lambda df: sorted(map(str, df.collect()))
    df = run()
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert joins and all("strategy=broadcast" in x for x in joins)
    monkeypatch.setattr(R, "broadcast_if_small", lambda df, limit=0: df)
    assert rows(run()) == rows(df) and df.count()


@pytest.mark.parametrize("query", ["context_assembly", "recall_at_k", "retrieve_sparse", "hybrid_topk", "retrieve_hybrid", "bm25_index_topk"])
def test_searches_ask_for_their_best(spark, monkeypatch, query):
    """No more leaves the blocks of postings than what can be among the best, of all that shares a token."""
    from kvist.plans import ranking

    name = "index_scores" if "index" in query else "bm25_scores"
    asked, score = [], getattr(R, name)

    def noted(*args, **kinds):
        asked.append((args, kinds, score(*args, **kinds)))
        return asked[-1][2]

    monkeypatch.setattr(R, name, noted)
    ranking.CATALOGUE.queries[query](spark, "/root/testdata/sf0.01")
    (args, kinds, found), = asked
    whole = score(*args[:4] if "index" in query else args[:8]).count()
    assert whole > 3000 and found.count() < whole / 4
