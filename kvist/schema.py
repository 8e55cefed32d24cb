"""Explicit schemas of the record files; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _S) for n in names]


def _of(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


MANIFEST = T.StructType([
    *_strings("url", "final_url"), T.StructField("status", T.IntegerType()), *_strings("downloaded_at", "path", "sha256", "content_type"),
])
PROVISIONS = T.StructType(_strings(
    "source", "doc_type", "root_print_url", "final_url", "canonical_root_print_url", "downloaded_at", "source_path", "sha256", "chapter",
    "section_id", "title", "reg_text", "guidance_text", "full_text",
))
CHUNK_METADATA = T.StructType([*_strings("source", "section_id", "title", "chapter", "text_type"), *_of(T.IntegerType(), "para_start", "para_end")])
CHUNKS = T.StructType([T.StructField("text", _S), T.StructField("metadata", CHUNK_METADATA)])
COLLECTION = T.StructType([T.StructField("id", _S), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("document", _S), T.StructField("metadata", CHUNK_METADATA)])
QUESTIONS = T.StructType([
    *_strings("id", "question_type", "question"), T.StructField("requires_qualification", T.BooleanType()), T.StructField("qualification_reason", _S),
    T.StructField("target_sections", T.ArrayType(_S)), T.StructField("difficulty", _S), T.StructField("should_refuse", T.BooleanType()), *_strings("refusal_type", "notes"),
])
SOURCE = T.StructType([*_strings("section_id", "title", "chapter", "text_type", "text"), T.StructField("distance", T.DoubleType())])
STORE = T.StructType([*_strings("chroma_dir", "collection"), T.StructField("count", T.LongType()), T.StructField("sqlite_sha256", _S), T.StructField("sqlite_size", T.LongType())])
RUN_LOG = T.StructType([
    *_strings("prompt_version", "system_prompt_sha256", "id", "question", "question_type"), T.StructField("should_refuse", T.BooleanType()), *_strings("refusal_type"),
    *_of(T.BooleanType(), "model_refused", "refused_tagged", "refused_heuristic"), *_strings("status"),
    *_of(T.BooleanType(), "retrieval_hit", "any_hit", "full_hit", "partial_hit", "answer_correct", "answer_correct_strict", "answer_supported",
         "unsupported_non_refusal", "partial_support_non_refusal", "ungrounded_non_refusal"),
    T.StructField("groundedness_score", T.DoubleType()), T.StructField("answer_grounded", T.BooleanType()),
    *_of(T.ArrayType(_S), "target_sections", "normalized_target_sections", "retrieved_section_ids", "normalized_retrieved_sections"),
    *_strings("answer"), T.StructField("sources", T.ArrayType(SOURCE)), *_strings("llm_finish_reason"), T.StructField("llm_usage", T.MapType(_S, T.LongType())),
    *_strings("mode"), T.StructField("top_k", T.IntegerType()), *_strings("retrieval_method"), T.StructField("hybrid_alpha", T.DoubleType()), *_strings("model"),
    T.StructField("temperature", T.DoubleType()), *_strings("embed_provider", "embed_model"), T.StructField("vectorstore", STORE),
    T.StructField("requires_qualification", T.BooleanType()), *_strings("qualification_reason"), T.StructField("qualification_warning_present", T.BooleanType()), *_strings("error"),
])
RETRIEVAL_LOG = T.StructType([
    *_strings("id", "question"), *_of(T.ArrayType(_S), "target_sections", "retrieved_sections"), *_of(T.BooleanType(), "has_targets", "requires_qualification", "any_hit", "full_hit"),
    T.StructField("top_k", T.IntegerType()), *_strings("retrieval_method"), T.StructField("hybrid_alpha", T.DoubleType()), *_strings("embed_provider", "embed_model", "collection_name", "chroma_dir"),
])
