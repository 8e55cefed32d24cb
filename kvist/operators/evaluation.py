"""Scoring of answered items: section coverage, refusals, groundedness, and the category of each item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvist.functions import text as T

GROUNDED = 0.25

# The categories of the conditional refusal summary.
CATEGORIES = [
    "retrieval_miss_correct_refusal", "over_refusal_with_partial_evidence", "over_refusal_with_full_evidence", "answer_without_evidence",
    "partial_support_answer", "correct_answer", "correct_qualified_answer", "missing_qualification_warning",
    "correct_refusal_with_partial_context", "correct_refusal_with_full_context", "under_refusal_with_partial_context",
    "under_refusal_with_full_context", "unsafe_answer_no_evidence", "other",
]


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def clean_items(questions: DataFrame) -> DataFrame:
    """Questions with blank ones dropped, strings stripped, blank types and reasons null, missing flags false."""
    q = questions.withColumn("question", T.strip(F.col("question"))).filter("question <> ''")
    for c in ("question_type", "refusal_type", "qualification_reason"):
        q = q.withColumn(c, T.blank_to_null(F.col(c)))
    for c in ("should_refuse", "requires_qualification"):
        q = q.withColumn(c, false_if_null(F.col(c)))
    return q.withColumn("target_sections", F.coalesce("target_sections", F.array().cast("array<string>")))


def coverage(df: DataFrame, targets: str = "target_sections", retrieved: str = "retrieved_section_ids", qualification: str = "requires_qualification") -> DataFrame:
    """Adds the normal forms of targets and retrieved sections, any_hit, full_hit and partial_hit."""
    t, r, q = F.col("normalized_target_sections"), F.col("normalized_retrieved_sections"), false_if_null(F.col(qualification))
    out = df.withColumn("normalized_target_sections", T.section_set(F.col(targets))).withColumn("normalized_retrieved_sections", T.section_set(F.col(retrieved)))
    return out.withColumns({"any_hit": T.any_hit(t, r), "full_hit": T.full_hit(t, r, q), "partial_hit": T.partial_hit(t, r, q)})


def model_refused(qualification: Column, any_hit: Column, warning: Column, tagged: Column, heuristic: Column) -> Column:
    """A warned answer with evidence to a question that needs qualification is none; else the tag or the heuristic decides."""
    return F.when(qualification & any_hit & warning, F.lit(False)).otherwise(tagged | heuristic)


def score_answers(df: DataFrame, threshold: float = GROUNDED, tag: str = T.REFUSAL_TAG, least: int = 4) -> DataFrame:
    """Adds the refusal flags, groundedness, correctness and status to items with coverage, answer and sources.

    An item with an ``error`` is ``query_failed``: its findings are null, its correctness false. tag: what
    marks a refusal; least: letters of a content word.
    """
    ok = F.col("error").isNull() if "error" in df.columns else F.lit(True)
    df = df.withColumns({
        "should_refuse": false_if_null(F.col("should_refuse")), "requires_qualification": false_if_null(F.col("requires_qualification")),
        "refused_tagged": T.has_refusal_tag(F.col("answer"), tag), "refused_heuristic": T.classify_refusal(F.col("answer"), tag),
        "qualification_warning_present": T.has_qualification_warning(F.col("answer")),
        "groundedness_score": T.groundedness(F.col("answer"), F.col("sources"), least),
    })
    should, need, any_, full, partial, warned = (F.col(c) for c in ("should_refuse", "requires_qualification", "any_hit", "full_hit", "partial_hit", "qualification_warning_present"))
    df = df.withColumn("model_refused", model_refused(need, any_, warned, F.col("refused_tagged"), F.col("refused_heuristic")))
    refused, grounded = F.col("model_refused"), F.col("groundedness_score") >= threshold
    right = F.when(should, refused).when(refused, F.lit(False)).when(need, full & warned).otherwise(full)
    answered = ~should & ~refused
    df = df.withColumns({
        "answer_supported": F.when(answered, full), "answer_correct": right, "answer_correct_strict": F.when(answered, right & grounded).otherwise(right),
        "unsupported_non_refusal": answered & ~any_, "partial_support_non_refusal": answered & partial, "ungrounded_non_refusal": answered & full & ~grounded,
        "answer_grounded": F.when(answered, grounded), "status": item_status(should, refused, need, any_, full, partial, warned, grounded),
    })
    for c in ("model_refused", "refused_tagged", "refused_heuristic", "any_hit", "full_hit", "partial_hit", "answer_supported", "groundedness_score", "answer_grounded", "qualification_warning_present"):
        df = df.withColumn(c, F.when(ok, F.col(c)))
    for c in ("answer_correct", "answer_correct_strict", "unsupported_non_refusal", "partial_support_non_refusal", "ungrounded_non_refusal"):
        df = df.withColumn(c, ok & F.col(c))
    return df.withColumn("status", F.when(ok, F.col("status")).otherwise(F.lit("query_failed"))).withColumn("retrieval_hit", F.col("any_hit"))


def item_status(should: Column, refused: Column, need: Column, any_: Column, full: Column, partial: Column, warned: Column, grounded: Column) -> Column:
    """One of eleven states of an answered item."""
    # The names of the states.
    return (
        F.when(should & refused, "correct_refusal").when(should, "under_refusal").when(refused, "over_refusal")
        .when(need & ~any_, "unsupported_qualified_answer").when(need & ~warned, "missing_qualification_warning")
        .when(need & full & ~grounded, "ungrounded_qualified_answer").when(need, "correct_qualified_answer")
        .when(~any_, "unsupported_answer").when(partial, "partial_support_answer").when(full & ~grounded, "ungrounded_answer").otherwise("correct_answer")
    )


def refusal_category(any_: Column, full: Column, partial: Column, should: Column, refused: Column, need: Column | None = None, warned: Column | None = None) -> Column:
    """One of CATEGORIES; need and warned are taken as false where they aren't given."""
    need, warned = need if need is not None else F.lit(False), warned if warned is not None else F.lit(False)
    qualified = need & ~should & ~refused
    out = F.when(qualified & ~any_, "answer_without_evidence").when(qualified & ~warned, "missing_qualification_warning").when(qualified, "correct_qualified_answer")
    out = out.when(~any_ & should & refused, "retrieval_miss_correct_refusal").when(~any_ & ~should & ~refused, "answer_without_evidence")
    for hit, name in ((partial, "partial"), (full, "full")):
        out = out.when(hit & ~should & refused, f"over_refusal_with_{name}_evidence").when(hit & ~should & ~refused, "partial_support_answer" if name == "partial" else "correct_answer")
        out = out.when(hit & should & refused, f"correct_refusal_with_{name}_context").when(hit & should & ~refused, f"under_refusal_with_{name}_context")
    return out.when(~any_ & should & ~refused, "unsafe_answer_no_evidence").otherwise("other")
