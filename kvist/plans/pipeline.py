"""The corpus build as one lineage: pages to provisions to chunks to collection, files written where they are wanted."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvist.config import Settings
from kvist.functions.text import fusion_key
from kvist.operators.answering import retrieval_run, run_questions, run_sweep
from kvist.operators.chunking import chunk_documents, documents_of
from kvist.providers import embed_chunks, embedder
from kvist.schema import CHUNKS, PROVISIONS, QUESTIONS
from kvist.sources.html import page_blocks, provision_records, provisions_of, read_pages
from kvist.sources.manifest import latest_valid, read_manifest, resolve
from kvist.sources.records import read_chunks, read_jsonl, validate_chunks, write_jsonl
from kvist.sources.store import fingerprint, open_collection, refresh


def parse(spark: SparkSession, manifest: str, root: str, out: str) -> int:
    """Provisions of the latest valid snapshot of a manifest, as JSON Lines; FileNotFoundError without its page."""
    line = latest_valid(read_manifest(spark, manifest)).first()
    path = resolve(line["path"], root)
    if not os.path.exists(path):
        raise FileNotFoundError(f"no snapshot at {path}")
    pages = read_pages(spark, path).select(F.lit(path).alias("source_path"), "content")
    snapshot = spark.createDataFrame([(path, *(line[c] for c in ("url", "final_url", "downloaded_at", "sha256")))], "source_path string, url string, final_url string, downloaded_at string, sha256 string")
    records = provision_records(provisions_of(page_blocks(pages, "source_path"), "source_path"), snapshot).orderBy("pos").drop("pos")
    write_jsonl(records, out, single=True)
    return spark.read.text(out).count()


def chunk(spark: SparkSession, provisions: str, out: str, size: int = 800, overlap: int = 200) -> int:
    """Chunks of a provisions file, as JSON Lines."""
    rows = chunk_documents(documents_of(read_jsonl(spark, provisions, PROVISIONS)), size, overlap)
    write_jsonl(rows.orderBy("ord", F.desc("metadata.text_type"), "piece").select("text", "metadata"), out)
    return spark.read.text(out).count()


def ingest(spark: SparkSession, chunks: str, store: str, cfg: Settings) -> int:
    """Embed a chunks file and replace the collection."""
    rows = validate_chunks(read_jsonl(spark, chunks, CHUNKS))
    return refresh(embed_chunks(rows, embedder(cfg.embed_provider, cfg.embed_model, cfg.embed_base_url, cfg.api_key)), store)


def sides(spark: SparkSession, chunks: str, store: str) -> tuple[DataFrame, DataFrame]:
    """What retrieval searches: the collection (id, key, embedding, document, metadata) and the chunks (ord, key, text, metadata), whole."""
    key = lambda df, body: df.withColumn("key", fusion_key(F.col(body), F.col("metadata")))
    return key(open_collection(spark, store), "document"), key(read_chunks(spark, chunks, CHUNKS).withColumnRenamed("_ord", "ord"), "text")


def evaluate(spark: SparkSession, questions: str, chunks: str, store: str, cfg: Settings, runs: list[dict] | None = None) -> DataFrame:
    """The run log of a question file, or those of a grid of runs; the sparse side reads the chunks, the dense side the collection."""
    collection, rows = sides(spark, chunks, store)
    asked = read_jsonl(spark, questions, QUESTIONS)
    log = run_sweep(asked, collection, rows, runs, cfg) if runs else run_questions(asked, collection, rows, cfg)
    # The fingerprint is one row.
    facts = fingerprint(open_collection(spark, store)).select(F.struct(F.lit(store).alias("chroma_dir"), F.lit(os.path.basename(store.rstrip("/"))).alias("collection"), "count", F.col("sha256").alias("sqlite_sha256"), F.lit(None).cast("bigint").alias("sqlite_size")).alias("vectorstore"))
    return log.crossJoin(F.broadcast(facts))


def recall(spark: SparkSession, questions: str, chunks: str, store: str, cfg: Settings) -> DataFrame:
    """The retrieval log of a question file: what is retrieved, without asking a model."""
    log = retrieval_run(read_jsonl(spark, questions, QUESTIONS), *sides(spark, chunks, store), cfg)
    return log.withColumns({"collection_name": F.lit(os.path.basename(store.rstrip("/"))), "chroma_dir": F.lit(store)})


def build(spark: SparkSession, manifest: str, root: str, work: str, cfg: Settings, questions: str | None = None) -> dict[str, int]:
    """Parse, chunk, ingest, and evaluate where questions are given, in one go; the number of records of each step."""
    done = {
        "provisions": parse(spark, manifest, root, f"{work}/provisions"), "chunks": chunk(spark, f"{work}/provisions", f"{work}/chunks", cfg.chunk_size, cfg.chunk_overlap),
        "collection": ingest(spark, f"{work}/chunks", f"{work}/collection", cfg),
    }
    if questions:
        write_jsonl(evaluate(spark, questions, f"{work}/chunks", f"{work}/collection", cfg), f"{work}/run")
        done["run"] = spark.read.text(f"{work}/run").count()
    return done
