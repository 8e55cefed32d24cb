"""Files in and out, settings, and the whole way from a page to an evaluated run, offline."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kvist.__main__ import main
from kvist.config import settings
from kvist.plans import pipeline
from kvist.providers import chat, chat_column, embedder, hashing_embedder
from kvist.operators.sweep import grid
from kvist.schema import CHUNKS, MANIFEST, QUESTIONS, RETRIEVAL_LOG
from kvist.sources import manifest as M
from kvist.sources.records import file_order, last_wins, read_jsonl, tsv_report, validate_chunks, write_csv, write_jsonl
from kvist.sources.store import fingerprint, open_collection, refresh
from test_corpus import PAGE


def test_records(spark, tmp_path):
    f = tmp_path / "m.jsonl"
    f.write_text('{"url": "u", "status": 200}\n\nnot json\n{"url": "v", "path": "p", "extra": 1}\n', encoding="utf-8")
    rows = M.read_manifest(spark, str(f)).orderBy("_ord").collect()
    assert [(r["url"], r["final_url"], r["status"], r["path"]) for r in rows] == [("u", "u", 200, ""), ("v", "v", 0, "p")]
    with pytest.raises(Exception, match="malformed"):
        read_jsonl(spark, str(f), MANIFEST).collect()
    out = read_jsonl(spark, str(f), MANIFEST, lenient=True, run="file")
    assert {r["file"] for r in out.collect()} == {"m.jsonl"}
    write_csv([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, {"k": 1})], "a int, b map<string,int>")], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["a", "b"]
    assert tsv_report(spark.createDataFrame([(0.12345, None)], "x double, y string")) == "x\ty\n0.123\t"
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (" ", 3, "z"), (None, 4, "w")], "id string, _ord int, v string")
    assert [tuple(r) for r in last_wins(df, "id").collect()] == [("a", 2, "y")] and last_wins(df, "id", keep="first").first()["v"] == "x"
    with pytest.raises(Exception, match="needs text"):
        validate_chunks(spark.createDataFrame([(None, None)], "text string, metadata string")).collect()


def test_download_and_latest(spark, tmp_path):
    log, got = str(tmp_path / "manifest"), []

    def get(url):
        got.append(url)
        return url, 200, PAGE.encode(), "text/html; charset=utf-8"

    first = M.download(spark, "http://x/p", log, str(tmp_path / "data"), str(tmp_path), get=get)
    assert first["path"].startswith("data/") and M.download(spark, "http://x/p", log, str(tmp_path / "data"), str(tmp_path), get=get)["skipped"] and len(got) == 1
    M.append_line(spark, {"url": "http://x/z"}, str(tmp_path / "folder" / "plain.jsonl"))
    bad = M.download(spark, "http://x/q", log, str(tmp_path / "data"), str(tmp_path), get=lambda u: (u, 404, b"", None))
    assert bad["path"] == "" and bad["sha256"] == ""
    assert M.latest_valid(M.read_manifest(spark, log)).first()["url"] == "http://x/p"
    with pytest.raises(Exception, match="no valid snapshot"):
        M.latest_valid(spark.createDataFrame([], "_ord bigint, url string, status int, path string, content_type string")).collect()


def test_end_to_end(spark, tmp_path, capsys):
    log = str(tmp_path / "manifest")
    M.download(spark, "http://x/p", log, str(tmp_path / "data"), str(tmp_path), get=lambda u: (u, 200, PAGE.encode(), "text/html"))
    cfg = settings(environ={}, retrieval_method="hybrid")
    assert pipeline.build(spark, log, str(tmp_path), str(tmp_path / "w"), cfg) == {"provisions": 3, "chunks": 4, "collection": 4}
    questions = spark.createDataFrame([("q1", "in_scope_single", "Hva er andre?", False, None, ["1-2"], "easy", False, None, ""), ("q2", None, " ", False, None, None, None, None, None, None)], QUESTIONS)
    write_jsonl(questions, str(tmp_path / "q"), single=True)
    run = pipeline.evaluate(spark, str(tmp_path / "q"), str(tmp_path / "w/chunks"), str(tmp_path / "w/collection"), cfg).collect()
    assert len(run) == 1 and run[0]["any_hit"] and run[0]["status"] == "correct_answer"
    assert main(["evaluate", "--chunks", str(tmp_path / "w/chunks"), "--store", str(tmp_path / "w/collection"), "--question", "Hva er andre?"]) == 0
    assert main(["evaluate", "--chunks", str(tmp_path / "w/chunks"), "--store", str(tmp_path / "w/collection"), "--eval-file", str(tmp_path / "q"), "--out", str(tmp_path / "r1")]) == 0
    assert main(["summarize", "--glob", str(tmp_path / "r1"), "--out-csv", str(tmp_path / "s")]) == 0 and main(["taxonomy", "--glob", str(tmp_path / "r1")]) == 0
    assert main(["compare", "--a", str(tmp_path / "r1"), "--b", str(tmp_path / "r1")]) == 0 and main(["check-store", "--store", str(tmp_path / "w/collection")]) == 0
    assert main(["questions", "--corpus", str(tmp_path / "w/provisions"), "--out", str(tmp_path / "qs"), "--n-in-scope", "2", "--n-refuse", "3"]) == 0
    assert spark.read.json(str(tmp_path / "qs")).count() == 5
    assert main(["sweep", "--eval-file", str(tmp_path / "q"), "--chunks", str(tmp_path / "w/chunks"), "--store", str(tmp_path / "w/collection"), "--out", str(tmp_path / "sw"), "--top-k", "1,2"]) == 0
    assert spark.read.json(str(tmp_path / "sw")).select("run").distinct().count() == 2
    capsys.readouterr()


def test_lines_keep_their_order(spark, tmp_path):
    """Appends of falling sizes, a plain file that is appended to, and a folder of many parts."""
    folder, plain = tmp_path / "folder", tmp_path / "m.jsonl"
    folder.mkdir()
    for i, size in enumerate((3000, 200, 0)):
        for path in (folder, plain):
            M.append_line(spark, {"url": f"u{i}", "path": "x" * size, "status": 200, "content_type": "text/html"}, str(path))
    for path in (folder, plain):
        rows = M.read_manifest(spark, str(path))
        assert [r["url"] for r in rows.orderBy("_ord").collect()] == ["u0", "u1", "u2"]
        assert M.latest_valid(rows.filter("url <> 'u2'")).first()["url"] == "u1"
    many = spark.range(500).select(F.col("id").cast("string").alias("url"), F.repeat(F.lit("y"), ((F.lit(500) - F.col("id")) * 7).cast("int")).alias("path")).repartitionByRange(12, F.col("id").cast("int"))
    write_jsonl(many, str(tmp_path / "parts"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for path in ("parts", "parts/*.json"):
            assert [r["url"] for r in read_jsonl(spark, str(tmp_path / path), MANIFEST).orderBy("_ord").collect()] == [str(i) for i in range(500)]
        write_jsonl(many, str(tmp_path / "one"), single=True)
        assert [r["url"] for r in read_jsonl(spark, str(tmp_path / "one"), MANIFEST, run="run").orderBy("_ord").collect()] == [str(i) for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in read_jsonl(spark, str(tmp_path / "one"), MANIFEST, run="run").select("run").distinct().collect()] == ["one"]
    assert sorted(["part-100000-a", "part-99999-b", "part-00002-c"], key=file_order) == ["part-00002-c", "part-99999-b", "part-100000-a"]


def test_parts_of_one_unit_are_found(spark, tmp_path):
    """Parts of an oversized unit share their key; the second one is the answer, whichever side finds it."""
    meta = ("s", "§ 8-5", "T", None, "regulation", 1, 1)
    texts = ["trapp rampe heis " * 3, "lyd støy demping " * 3, "energi varme kulde " * 3]
    write_jsonl(spark.createDataFrame([(t, meta) for t in texts] + [(None, ("s", "§ 9-1", "U", None, "guidance", 1, 1))], CHUNKS).coalesce(1), str(tmp_path / "c"))
    chunks = spark.createDataFrame([(t, meta) for t in texts], CHUNKS)
    write_jsonl(chunks, str(tmp_path / "good"), single=True)
    cfg = settings(environ={}, top_k=1)
    assert pipeline.ingest(spark, str(tmp_path / "good"), str(tmp_path / "store"), cfg) == 3
    write_jsonl(spark.createDataFrame([("q", "in_scope_single", "Hva gjelder for lyd, støy og demping?", False, None, ["8-5"], "easy", False, None, "")], QUESTIONS), str(tmp_path / "q"), single=True)
    for method in ("dense", "sparse", "hybrid"):
        one = settings(environ={}, top_k=1, retrieval_method=method)
        row = pipeline.evaluate(spark, str(tmp_path / "q"), str(tmp_path / "c"), str(tmp_path / "store"), one).first()
        assert [s["text"] for s in row["sources"]] == [texts[1]] and row["vectorstore"]["count"] == 3, method
        log = pipeline.recall(spark, str(tmp_path / "q"), str(tmp_path / "c"), str(tmp_path / "store"), one)
        assert log.first()["retrieved_sections"] == ["§ 8-5"] and set(RETRIEVAL_LOG.fieldNames()) <= set(log.columns)


def test_settings_reach_the_run(spark, tmp_path):
    chunks = spark.createDataFrame([(f"trapp nummer {i}", ("s", f"§ 1-{i}", "T", None, "regulation", i, i)) for i in range(12)], CHUNKS)
    write_jsonl(chunks, str(tmp_path / "c"), single=True)
    pipeline.ingest(spark, str(tmp_path / "c"), str(tmp_path / "s"), settings(environ={}))
    write_jsonl(spark.createDataFrame([("q", None, "trapp?", True, "x", ["1-2"], "easy", False, None, "")], QUESTIONS), str(tmp_path / "q"), single=True)
    run = lambda **kw: pipeline.evaluate(spark, str(tmp_path / "q"), str(tmp_path / "c"), str(tmp_path / "s"), settings(environ={}, retrieval_method="hybrid", top_k=2, **kw)).first()
    assert len(run()["sources"]) == 10 and len(run(qualification_k=3)["sources"]) == 3
    assert run(refusal_tag="TRAPP")["refused_tagged"] and not run()["refused_tagged"]
    assert run(content_word_length=40)["groundedness_score"] == 0.0 < run()["groundedness_score"]


def test_benchmark_recall_and_empty_runs(spark, tmp_path, capsys):
    chunks = spark.createDataFrame([("trapp", ("s", "§ 1-1", "T", None, "regulation", 1, 1))], CHUNKS)
    write_jsonl(chunks, str(tmp_path / "c"), single=True)
    pipeline.ingest(spark, str(tmp_path / "c"), str(tmp_path / "s"), settings(environ={}))
    write_jsonl(spark.createDataFrame([("q", None, "trapp?", False, None, ["1-1"], "easy", False, None, "")], QUESTIONS), str(tmp_path / "q"), single=True)
    files = ["--eval-file", str(tmp_path / "q"), "--chunks", str(tmp_path / "c"), "--store", str(tmp_path / "s")]
    assert main(["benchmark", "--models", "offline:a,offline:b", *files, "--out", str(tmp_path / "b"), "--out-csv", str(tmp_path / "csv"), "--pairs"]) == 0
    assert spark.read.json(str(tmp_path / "b")).select("run").distinct().count() == 2 and "delta_accuracy" in capsys.readouterr().out
    assert main(["recall", *files, "--out", str(tmp_path / "r"), "--retrieval-method", "sparse"]) == 0
    assert capsys.readouterr().out.strip().splitlines()[-1].split("\t") == ["run", "1", "1.000", "1.000"]
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "none.jsonl").write_text("")
    (tmp_path / "runs" / "one.jsonl").write_text('{"id": "1", "should_refuse": true, "model_refused": true}\n')
    assert main(["summarize", "--glob", str(tmp_path / "runs" / "*.jsonl")]) == 0
    lines = [x.split("\t")[:2] for x in capsys.readouterr().out.strip().splitlines()[1:]]
    assert sorted(lines) == [["none.jsonl", "0"], ["one.jsonl", "1"]]
    first, second = grid(1, [], [1], ["dense"], [0.5], [0.1], stamp="t1")[0]["run"], grid(1, [], [1], ["dense"], [0.5], [0.1], stamp="t2")[0]["run"]
    assert first != second and first.startswith("t1_run001")


def test_whole_pipeline_with_questions(spark, tmp_path):
    log = str(tmp_path / "manifest.jsonl")
    M.download(spark, "http://x/p", log, str(tmp_path / "data"), str(tmp_path), get=lambda u: (u, 200, PAGE.encode(), "text/html"))
    write_jsonl(spark.createDataFrame([("q", None, "Hva er andre?", False, None, ["1-2"], "easy", False, None, "")], QUESTIONS), str(tmp_path / "q"), single=True)
    assert pipeline.build(spark, log, str(tmp_path), str(tmp_path / "w"), settings(environ={}), str(tmp_path / "q"))["run"] == 1


def test_shared_folder_of_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from kvist.session import shared_folder

    fake = lambda master, found=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: found, set=lambda *a: None), sparkContext=SimpleNamespace(master=master, getConf=lambda: {}))
    for master in ("spark://x:7077", "local-cluster[3,4,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_folder(fake(master))
        assert shared_folder(fake(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(fake("local[4]")).startswith("file:///")


def test_store(spark, tmp_path):
    with pytest.raises(RuntimeError):
        open_collection(spark, str(tmp_path / "none"))
    chunks = spark.createDataFrame([("t", ("s", "1-1", None, None, "regulation", 1, 1), [1.0], 1), ("t", ("s", "1-1", "new", None, "regulation", 1, 1), [2.0], 2)], "text string, metadata struct<source:string,section_id:string,title:string,chapter:string,text_type:string,para_start:int,para_end:int>, embedding array<float>, _ord bigint")
    assert refresh(chunks, str(tmp_path / "c")) == 1 and open_collection(spark, str(tmp_path / "c")).first()["embedding"] == [2.0]
    a, b = fingerprint(chunks).first(), fingerprint(chunks.repartition(3)).first()
    assert a == b and fingerprint(chunks.limit(0)).first()["count"] == 0


def test_providers_fail_alone(spark):
    def talk(messages):
        if "bad" in messages[-1]["content"]:
            raise OSError("down")
        return {"content": "ok", "finish_reason": "stop", "usage": {"n": 1}}

    df = spark.createDataFrame([("s", "good"), ("s", "bad"), (None, None)], "a string, b string")
    assert sorted((r["answer"] or "", r["error"] or "") for r in chat_column(df, "a", "b", talk).collect()) == [("", "down"), ("ok", ""), ("ok", "")]
    assert hashing_embedder(8)([""]) == [[0.0] * 8]
    for f in (embedder, chat):
        with pytest.raises(ValueError):
            f("somewhere")
        with pytest.raises(ValueError):
            f("openai")


def test_settings(tmp_path):
    ini = tmp_path / "k.conf"
    ini.write_text("[retrieval]\ntop_k = 14\nhybrid_alpha = x\n[llm]\nmodel = m\n")
    s = settings(str(ini), {"KVIST_LLM_MODEL": "env"}, prompt_version="strict")
    assert (s.top_k, s.hybrid_alpha, s.llm_model, s.prompt_version) == (14, 0.5, "env", "strict")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and json.dumps(sorted(__spark_entry__.queries()))
    assert spark.range(1).select(F.lit(1)).count() == 1
