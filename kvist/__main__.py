"""Command line: download, parse, chunk, ingest, pipeline, evaluate, recall, sweep, benchmark, summarize, taxonomy, compare, questions, check-store."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kvist.config import settings
from kvist.operators import questions as Q
from kvist.operators import summaries as S
from kvist.operators.sweep import csv_list, grid, grid_table, time_stamp
from kvist.plans import pipeline
from kvist.schema import PROVISIONS, RETRIEVAL_LOG, RUN_LOG
from kvist.sources import manifest as M
from kvist.sources.records import read_jsonl, run_names, tsv_report, write_csv, write_jsonl
from kvist.sources.store import fingerprint, open_collection


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kvist")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *required: str, **optional) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for r in required:
            c.add_argument(f"--{r}", required=True)
        for o, default in optional.items():
            c.add_argument(f"--{o.replace('_', '-')}", default=default, type=type(default) if default is not None else str)
        return c

    command("download", "url", "out-dir", "manifest").add_argument("--force", action="store_true")
    command("parse", "manifest", "out", root=".")
    command("chunk", "jsonl", "out", chunk_size=800, chunk_overlap=200)
    command("ingest", "chunks", "store", embed_provider=None, embed_model=None, embed_base_url=None)
    command("pipeline", "manifest", "work", root=".", eval_file=None)
    run = dict(retrieval_method=None, llm_provider=None, llm_model=None, embed_provider=None, embed_model=None, prompt_version=None, mode=None)
    e = command("evaluate", "chunks", "store", eval_file=None, question=None, out=None, **run)
    r = command("recall", "eval-file", "chunks", "store", out=None, retrieval_method=None, embed_provider=None, embed_model=None)
    for c in (e, r):
        for name, kind in (("top-k", int), ("hybrid-alpha", float), ("candidate-multiplier", int)):
            c.add_argument(f"--{name}", type=kind)
    for name, kind in (("temperature", float), ("groundedness-threshold", float)):
        e.add_argument(f"--{name}", type=kind)
    command("summarize", "glob", out_csv=None)
    command("taxonomy", "glob", out_csv=None)
    command("compare", "a", "b", out=None, show=50)
    command("questions", "corpus", "out", n_in_scope=80, n_refuse=40, seed=17, style="paraphrase", multi_frac=0.0, multi_max_sections=3, refuse_in_domain_frac=0.5)
    s = command("sweep", "eval-file", "chunks", "store", "out", top_k="6", retrieval_method="dense", hybrid_alpha="0.5", temperature="0.3", prompt_version="baseline", llm_model="llama3.2")
    s.add_argument("--repeat", type=int)
    s.add_argument("--dry-run", action="store_true")
    b = command("benchmark", "models", "eval-file", "chunks", "store", "out", out_csv=None)
    b.add_argument("--pairs", action="store_true")
    command("check-store", "store")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kvist").getOrCreate()
    if a.command == "download":
        print(M.download(spark, a.url, a.manifest, a.out_dir, os.getcwd(), a.force))
    elif a.command == "parse":
        print(pipeline.parse(spark, a.manifest, a.root, a.out))
    elif a.command == "chunk":
        print(pipeline.chunk(spark, a.jsonl, a.out, a.chunk_size, a.chunk_overlap))
    elif a.command == "ingest":
        print(pipeline.ingest(spark, a.chunks, a.store, settings(embed_provider=a.embed_provider, embed_model=a.embed_model, embed_base_url=a.embed_base_url)))
    elif a.command == "evaluate":
        names = ("retrieval_method", "llm_provider", "llm_model", "embed_provider", "embed_model", "prompt_version", "mode", "top_k", "hybrid_alpha", "candidate_multiplier", "temperature", "groundedness_threshold")
        cfg = settings(**{n: getattr(a, n) for n in names})
        if a.question:
            return _one(spark, a, cfg)
        log = pipeline.evaluate(spark, a.eval_file, a.chunks, a.store, cfg).withColumns({"run": F.lit("run")}).cache()
        if a.out:
            write_jsonl(log.drop("run"), a.out)
        print(tsv_report(S.rates_with_intervals(log)), tsv_report(S.with_metrics(S.confusion_matrix(log))), tsv_report(S.refusal_by_type(log)), sep="\n\n")
    elif a.command == "recall":
        names = ("retrieval_method", "embed_provider", "embed_model", "top_k", "hybrid_alpha", "candidate_multiplier")
        log = pipeline.recall(spark, a.eval_file, a.chunks, a.store, settings(**{n: getattr(a, n) for n in names})).withColumn("run", F.lit("run")).cache()
        if a.out:
            write_jsonl(log.select(*RETRIEVAL_LOG.fieldNames()), a.out)
        print(tsv_report(S.recall_at_k(log)))
    elif a.command == "pipeline":
        print(pipeline.build(spark, a.manifest, a.root, a.work, settings(), a.eval_file))
    elif a.command in ("summarize", "taxonomy"):
        logs = read_jsonl(spark, a.glob, RUN_LOG, run="run")
        out = S.run_summary(logs, runs=run_names(spark, a.glob)) if a.command == "summarize" else S.order_runs(S.conditional_refusal(logs))
        if a.out_csv:
            write_csv([out], a.out_csv)
        print(tsv_report(out))
    elif a.command == "compare":
        x, y = (read_jsonl(spark, f, RUN_LOG) for f in (a.a, a.b))
        flips = S.refusal_flips(x, y)
        print(tsv_report(S.compare_runs(x, y)), tsv_report(S.flip_counts(x, y)), tsv_report(flips, limit=a.show), sep="\n\n")
        if a.out:
            write_jsonl(flips, a.out)
    elif a.command == "questions":
        rows = Q.question_set(read_jsonl(spark, a.corpus, PROVISIONS), a.n_in_scope, a.n_refuse, a.seed, a.multi_frac, a.multi_max_sections, a.refuse_in_domain_frac, a.style)
        write_jsonl(rows, a.out, single=True)
    elif a.command == "sweep":
        cfg = settings(repeat=a.repeat)
        runs = grid(cfg.repeat, csv_list(a.prompt_version), csv_list(a.top_k, int), csv_list(a.retrieval_method), csv_list(a.hybrid_alpha, float), csv_list(a.temperature, float), csv_list(a.llm_model), time_stamp())
        print(tsv_report(grid_table(spark, runs)))
        if not a.dry_run:
            pipeline.evaluate(spark, a.eval_file, a.chunks, a.store, cfg, runs).write.partitionBy("run").mode("append").json(a.out)
    elif a.command == "benchmark":
        cfg = settings()
        runs = grid(1, [cfg.prompt_version], [cfg.top_k], [cfg.retrieval_method], [cfg.hybrid_alpha], [cfg.temperature], csv_list(a.models), time_stamp())
        log = pipeline.evaluate(spark, a.eval_file, a.chunks, a.store, cfg, runs).withColumn("_ord", F.monotonically_increasing_id()).cache()
        log.drop("_ord").write.partitionBy("run").mode("append").json(a.out)
        summary = S.run_summary(log).join(grid_table(spark, runs).select("run", "run_idx"), "run")
        if a.out_csv:
            write_csv([summary], a.out_csv)
        print(tsv_report(summary))
        if a.pairs:
            print(tsv_report(S.pairwise_runs(summary, ["accuracy", "precision", "recall", "f1", "any_hit_rate", "full_hit_rate", "error_rate"])))
    elif a.command == "check-store":
        print(tsv_report(fingerprint(open_collection(spark, a.store))))
    return 0


def _one(spark: SparkSession, a: argparse.Namespace, cfg) -> int:
    from kvist.operators.answering import ask

    try:
        r = ask(a.question, *pipeline.sides(spark, a.chunks, a.store), cfg)
    except Exception as e:  # noqa: BLE001
        print(f"query failed: {e}", file=sys.stderr)
        return 2
    print(r["answer"], f"refused: {r['refused']}", *(f"- {s['section_id']} {s['title']} ({s['distance']:.3f})" for s in r["sources"]), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
