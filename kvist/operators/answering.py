"""Prompts and the run of a whole batch of questions: retrieve, assemble, ask, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvist.config import Settings
from kvist.functions.text import strip, text
from kvist.operators.evaluation import clean_items, coverage, score_answers
from kvist.operators.retrieval import chapter_filter, effective_k, fuse, join_found, retrieve
from kvist.operators.sweep import grid, grid_table
from kvist.providers import chat, chat_column, embed_column, embedder, provider_and_model
from kvist.session import broadcast_if_small, materialize, union_all

_RULE = "Begynn svaret med KAN_IKKE_SVARE: og en kort grunn "
#: Our own wording of the three strictnesses, and what is added where a question needs qualification.
PROMPTS = {
    "baseline": "Du kjenner byggteknisk forskrift. Svar på norsk, kort, og bare med det som står i konteksten; si hva som mangler. " + _RULE + "når konteksten ikke sier noe om spørsmålet, eller når det gjelder saksbehandling, gebyr eller søknader.",
    "relaxed": "Du kjenner byggteknisk forskrift. Bygg svaret på konteksten; du kan forklare sammenhenger som følger av den, og gi et delvis svar. " + _RULE + "bare når konteksten ikke har noe som angår spørsmålet.",
    "strict": "Du kjenner byggteknisk forskrift. Bruk bare det konteksten sier uttrykkelig, uten slutninger. " + _RULE + "når konteksten ikke gir et klart svar, eller når svaret krever beregning eller prosjektering.",
}
QUALIFICATION = " Spørsmålet krever opplysninger om prosjektet: gi et forsiktig delvis svar av det som finnes, og si at det trengs mer informasjon og at svaret kan variere."

def system_prompt(version: Column, qualification: Column) -> Column:
    """The prompt of a version (unknown: baseline), longer where qualification is needed."""
    v = F.lower(strip(text(version)))
    base = F.when(v == "relaxed", PROMPTS["relaxed"]).when(v == "strict", PROMPTS["strict"]).otherwise(PROMPTS["baseline"])
    return F.when(F.coalesce(qualification, F.lit(False)), F.concat(base, F.lit(QUALIFICATION))).otherwise(base)


def prompt_fingerprint(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def user_message(context: Column, question: Column, qualification: Column) -> Column:
    """Context, a rule, the question; with a reminder where qualification is needed."""
    hint = F.when(F.coalesce(qualification, F.lit(False)), F.lit(QUALIFICATION.strip() + "\n\n")).otherwise(F.lit(""))
    return F.concat(F.lit("Kontekst:\n\n"), text(context), F.lit("\n\n---\n\n"), hint, F.lit("Spørsmål: "), question)


def run_sweep(questions: DataFrame, collection: DataFrame, chunks: DataFrame, runs: list[dict], cfg: Settings) -> DataFrame:
    """The run logs of all questions under all runs of a grid, in one job, told apart by ``run``.

    collection (id, key, embedding, document, metadata), chunks (ord, key, text, metadata); keys may repeat,
    each row is ranked by itself (see retrieve). Each side is ranked once, for the largest k; runs differ by
    how far they read it and by how they weigh it. Items whose call fails are query_failed rows; blank
    questions are skipped. Answers are materialised before they are scored, so that no call is made twice.
    """
    spark = questions.sparkSession
    methods = {r["retrieval_method"] for r in runs}
    items = clean_items(questions).select("id", "question", "question_type", "should_refuse", "refusal_type", "requires_qualification", "qualification_reason", "target_sections")
    widest = max(*(r["top_k"] for r in runs), cfg.qualification_k) * (max(1, cfg.candidate_multiplier) if "hybrid" in methods else 1)
    # The grid is as many rows as the caller listed, made on the driver.
    pairs = items.crossJoin(F.broadcast(grid_table(spark, runs))).withColumn("k", effective_k(F.col("top_k"), F.col("requires_qualification"), cfg.qualification_k))
    sides, parts = {}, []
    if methods != {"sparse"}:
        asked = embed_column(items.select(F.col("id").alias("qid"), "question"), "question", embedder(cfg.embed_provider, cfg.embed_model, cfg.embed_base_url, cfg.api_key))
        sides["dense"] = materialize(retrieve("dense", widest, asked, collection))
    if methods != {"dense"}:
        sides["sparse"] = materialize(retrieve("sparse", widest, items.select(F.col("id").alias("qid"), "question"), chunks=chunks, k1=cfg.bm25_k1, b=cfg.bm25_b))
    asks = pairs.select("run", F.col("id").alias("qid"), "retrieval_method", "hybrid_alpha", "k")
    for m in sorted(methods - {"hybrid"}):
        near = asks.filter(F.col("retrieval_method") == m).join(sides[m], "qid").filter(F.col("rank") <= F.col("k"))
        parts.append(near.select("run", "qid", "side", "id", "rank", "distance"))
    if "hybrid" in methods:
        both = asks.filter("retrieval_method = 'hybrid'")
        wide = {n: both.join(d, "qid").filter(F.col("rank") <= F.col("k") * max(1, cfg.candidate_multiplier)).select(F.struct("run", "qid", "hybrid_alpha", "k").alias("qid"), "side", "id", "key", "distance") for n, d in sides.items()}
        fused = fuse(wide["dense"], wide["sparse"], F.col("qid.k"), F.col("qid.hybrid_alpha"))
        parts.append(fused.select("qid.run", "qid.qid", "side", "id", "rank", "distance"))
    facts = [collection.select(F.lit("dense").alias("side"), F.col("id").cast("string").alias("id"), F.col("document").alias("text"), "metadata")] if "dense" in sides else []
    facts += [chunks.select(F.lit("sparse").alias("side"), F.col("ord").cast("string").alias("id"), "text", "metadata")] if "sparse" in sides else []
    # Written first, so that the few rows found travel to the texts, and not the texts to them.
    near = union_all(facts).join(broadcast_if_small(materialize(union_all(parts))), ["side", "id"]).drop("side", "id").withColumnRenamed("qid", "id")
    near = near.join(items.select("id", "requires_qualification", "target_sections"), "id")
    near = near.withColumns({"qid": F.struct("run", "id"), "section_id": F.col("metadata.section_id")})
    near = chapter_filter(near, "requires_qualification", "target_sections", "section_id")
    source = lambda f: F.coalesce(f"metadata.{f}", F.lit("")).alias(f)
    rows = F.array_sort(F.collect_list(F.struct("rank", *[source(f) for f in ("section_id", "title", "chapter", "text_type")], text(F.col("text")).alias("text"), "distance")))
    context = near.groupBy("run", "id").agg(rows.alias("sources"))
    ready = pairs.drop("k").join(context, ["run", "id"], "left").withColumn("context", F.array_join(F.transform(F.coalesce("sources", F.array()), lambda s: s["text"]), "\n\n---\n\n"))
    prompt = system_prompt(F.col("prompt_version"), F.col("requires_qualification"))
    ready = ready.withColumns({"_system": prompt, "_user": user_message(F.col("context"), F.col("question"), F.col("requires_qualification"))})

    def talk(model: str, temperature: float):
        provider, name = provider_and_model(model or cfg.llm_model, cfg.llm_provider)
        return chat(provider, name, cfg.llm_base_url, cfg.api_key, temperature, cfg.max_tokens)

    answered = materialize(chat_column(ready, "_system", "_user", talk, ("model", "temperature")))
    answered = answered.withColumn("retrieved_section_ids", F.transform(F.coalesce("sources", F.array().cast(answered.schema["sources"].dataType)), lambda s: s["section_id"]))
    scored = score_answers(coverage(answered), cfg.groundedness_threshold, cfg.refusal_tag, cfg.content_word_length)
    more = {"mode": F.lit(cfg.mode), "embed_provider": F.lit(cfg.embed_provider), "embed_model": F.lit(cfg.embed_model), "system_prompt_sha256": prompt_fingerprint(F.col("_system"))}
    return scored.withColumns(more).drop("_system", "_user", "context")


def run_questions(questions: DataFrame, collection: DataFrame, chunks: DataFrame, cfg: Settings) -> DataFrame:
    """The run log of all questions under one setting; see run_sweep."""
    runs = grid(1, [cfg.prompt_version], [cfg.top_k], [cfg.retrieval_method], [cfg.hybrid_alpha], [cfg.temperature], [cfg.llm_model])
    return run_sweep(questions, collection, chunks, runs, cfg).drop("run", "run_idx", "repeat")


def ask(question: str, collection: DataFrame, chunks: DataFrame, cfg: Settings) -> dict:
    """One question: answer, whether it was refused, and the first ``preview`` sources."""
    spark = chunks.sparkSession
    schema = "id string, question string, question_type string, should_refuse boolean, refusal_type string, requires_qualification boolean, qualification_reason string, target_sections array<string>"
    row = run_questions(spark.createDataFrame([("1", question, None, False, None, False, None, [])], schema), collection, chunks, cfg).first()
    if row is None or row["error"]:
        raise RuntimeError(row["error"] if row else "a blank question")
    return {"answer": row["answer"], "refused": row["model_refused"], "sources": [s.asDict() for s in (row["sources"] or [])[: cfg.preview]]}


def recall_log(questions: DataFrame, ranked: DataFrame, metadata: DataFrame, *on: str) -> DataFrame:
    """Retrieval alone: questions with their retrieved sections and hits, without widening or chapter filter.

    ranked (qid, rank) and metadata meet in the columns ``on``, which name one row.
    """
    got = join_found(ranked, metadata.select(*on, F.coalesce("metadata.section_id", F.lit("")).alias("section")), *on).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "section"))).alias("r"))
    rows = questions.join(got.withColumnRenamed("qid", "id"), "id", "left").withColumn("retrieved_sections", F.transform(F.coalesce("r", F.array().cast("array<struct<rank:int,section:string>>")), lambda x: x["section"])).drop("r")
    return coverage(rows, retrieved="retrieved_sections").withColumn("has_targets", F.size(F.coalesce("target_sections", F.array().cast("array<string>"))) > 0)


def retrieval_run(questions: DataFrame, collection: DataFrame, chunks: DataFrame, cfg: Settings) -> DataFrame:
    """The retrieval log of all questions under one setting: no model is asked; collection and chunks as in run_sweep."""
    items = clean_items(questions)
    asked = items.select(F.col("id").alias("qid"), "question")
    if cfg.retrieval_method != "sparse":
        asked = embed_column(asked, "question", embedder(cfg.embed_provider, cfg.embed_model, cfg.embed_base_url, cfg.api_key))
    ranked = retrieve(cfg.retrieval_method, cfg.top_k, asked, collection, chunks, cfg.hybrid_alpha, cfg.bm25_k1, cfg.bm25_b, cfg.candidate_multiplier)
    row = lambda df, side, ident: df.select(F.lit(side).alias("side"), F.col(ident).cast("string").alias("row"), "metadata")
    facts = row(collection, "dense", "id").unionByName(row(chunks, "sparse", "ord"))
    log = recall_log(items, ranked.withColumnRenamed("id", "row"), facts, "side", "row")
    more = {"top_k": F.lit(cfg.top_k), "retrieval_method": F.lit(cfg.retrieval_method), "hybrid_alpha": F.lit(cfg.hybrid_alpha), "embed_provider": F.lit(cfg.embed_provider), "embed_model": F.lit(cfg.embed_model)}
    return log.withColumns(more)
