"""Aggregates over run logs: confusion, slices, run summaries, conditional refusal, comparisons of runs.

One job for all runs: ``run`` is a column, never a loop over files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kvist.functions import text as T
from kvist.functions.metrics import confusion, refusal_metrics, wilson
from kvist.operators.evaluation import CATEGORIES, false_if_null, refusal_category
from kvist.sources.records import last_wins

REFUSAL_TYPES = ["out_of_scope", "in_domain_missing_context", "(unspecified)"]
SLICES = ["in_scope_single", "in_scope_multi"]
FLAGS = ["unsupported_non_refusal", "partial_support_non_refusal", "ungrounded_non_refusal"]
METADATA = ["mode", "model", "temperature", "top_k", "retrieval_method", "hybrid_alpha", "prompt_version", "system_prompt_sha256"]


def answered() -> Column:
    return ~F.coalesce(F.col("status") == "query_failed", F.lit(False))


def hit() -> Column:
    return F.coalesce("any_hit", "retrieval_hit", F.lit(False))


def confusion_matrix(log: DataFrame, run: str = "run") -> DataFrame:
    """(run, tp, fp, tn, fn) over answered items."""
    return log.groupBy(run).agg(*[c.alias(n) for n, c in confusion(F.col("should_refuse"), F.col("model_refused"), answered()).items()])


def sliced_confusion(log: DataFrame, run: str = "run") -> DataFrame:
    """(run, slice, tp, fp, tn, fn) of the overlapping slices any_hit, no_hit, full_hit and partial_hit, in one pass."""
    slices = {"any_hit": hit(), "no_hit": ~hit(), "full_hit": false_if_null(F.col("full_hit")), "partial_hit": false_if_null(F.col("partial_hit"))}
    aggs = [c.alias(f"{s}_{n}") for s, w in slices.items() for n, c in confusion(F.col("should_refuse"), F.col("model_refused"), answered() & w).items()]
    rows = F.array(*[F.struct(F.lit(s).alias("slice"), *[F.col(f"{s}_{n}").alias(n) for n in ("tp", "fp", "tn", "fn")]) for s in slices])
    return log.groupBy(run).agg(*aggs).select(run, F.explode(rows).alias("s")).select(run, "s.*")


def with_metrics(matrix: DataFrame) -> DataFrame:
    """Adds the nine refusal metrics to columns tp, fp, tn and fn."""
    return matrix.select("*", *[c.alias(n) for n, c in refusal_metrics(*(F.col(x) for x in ("tp", "fp", "tn", "fn"))).items()])


def rates_with_intervals(log: DataFrame, run: str = "run") -> DataFrame:
    """Shares of all items, failed ones included, of right refusal behaviour, correct and strictly correct answers, with intervals."""
    right = answered() & (false_if_null(F.col("should_refuse")) == false_if_null(F.col("model_refused")))
    sums = log.groupBy(run).agg(
        F.count("*").alias("n"), F.count_if(~answered()).alias("query_failed"), F.count_if(right).alias("accuracy_n"),
        F.count_if(false_if_null(F.col("answer_correct"))).alias("correct_n"), F.count_if(false_if_null(F.col("answer_correct_strict"))).alias("strict_n"),
    )
    out = [run, "n", "query_failed"]
    for name in ("accuracy", "correct", "strict"):
        low, high = wilson(F.col(f"{name}_n"), F.col("n"))
        out += [T.safe_div(F.col(f"{name}_n"), F.col("n")).alias(name), low.alias(f"{name}_low"), high.alias(f"{name}_high")]
    return sums.select(*out)


def refusal_by_type(log: DataFrame, run: str = "run") -> DataFrame:
    """(run, refusal_type, n, refused, rate) of answered items to be refused."""
    kind = F.coalesce(T.blank_to_null(F.col("refusal_type")), F.lit("(unspecified)"))
    rows = log.filter(answered() & false_if_null(F.col("should_refuse"))).groupBy(run, kind.alias("refusal_type"))
    return rows.agg(F.count("*").alias("n"), F.count_if(false_if_null(F.col("model_refused"))).alias("refused")).withColumn("rate", T.safe_div(F.col("refused"), F.col("n")))


def run_summary(log: DataFrame, run: str = "run", order: str = "_ord", runs: DataFrame | None = None) -> DataFrame:
    """One wide row per run: the first row's settings, counts, rates, metrics, refusal types, in-scope slices and a breakdown as JSON.

    runs: (run) names of all runs; one without rows gives n = 0 and nulls.
    """
    ok, refused, should = answered(), false_if_null(F.col("model_refused")), false_if_null(F.col("should_refuse"))
    kind = T.question_type(F.col("question_type"), F.col("should_refuse"), F.col("target_sections"), F.col("id"))
    refusal = F.coalesce(T.blank_to_null(F.col("refusal_type")), F.lit("(unspecified)"))
    log = log.withColumns({"_kind": kind, "_type": refusal, "_ok": ok})
    kind, refusal, ok = F.col("_kind"), F.col("_type"), F.col("_ok")
    aggs = [F.min_by(F.struct(*METADATA), order).alias("_first"), F.count("*").alias("n"), F.count_if(ok).alias("n_ok")]
    aggs += [c.alias(n) for n, c in confusion(F.col("should_refuse"), F.col("model_refused"), ok).items()]
    aggs += [F.count_if(ok & w).alias(f"_{n}") for n, w in (("any", hit()), ("full", false_if_null(F.col("full_hit"))), ("partial", false_if_null(F.col("partial_hit"))))]
    aggs += [F.count_if(false_if_null(F.col(f))).alias(f) for f in FLAGS]
    aggs += [x for c in ("answer_correct", "answer_correct_strict") for x in (F.count_if(ok & F.col(c).isNotNull()).alias(f"_{c}_den"), F.count_if(ok & false_if_null(F.col(c))).alias(f"_{c}_n"))]
    aggs += [x for t in REFUSAL_TYPES for x in (F.count_if(ok & should & (refusal == t)).alias(f"refuse_n__{t}"), F.count_if(ok & should & (refusal == t) & refused).alias(f"refuse_refused__{t}"))]
    for s in SLICES:
        w = ok & ~should & (kind == s)
        strict = F.col("answer_correct_strict")
        aggs += [F.count_if(w).alias(f"slice_n__{s}"), F.count_if(w & refused).alias(f"_over__{s}"), F.count_if(w & strict.isNotNull()).alias(f"_den__{s}"), F.count_if(w & false_if_null(strict)).alias(f"_strict__{s}")]
        aggs += [F.count_if(w & false_if_null(F.col(f))).alias(f"_{f}__{s}") for f in FLAGS]
    g = log.groupBy(run).agg(*aggs)
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    whole = lambda a, b: T.safe_div(F.col(a), F.col(b))
    cols = [F.col(run), F.col("n"), F.col("n_ok"), (F.col("n") - F.col("n_ok")).alias("n_errors"), T.safe_div(F.col("n") - F.col("n_ok"), F.col("n")).alias("error_rate"), "tp", "fp", "tn", "fn"]
    cols += [whole(f"_{h}", "n_ok").alias(f"{h}_hit_rate") for h in ("any", "full", "partial")] + [whole("_any", "n_ok").alias("retrieval_hit_rate")]
    cols += [x for f in FLAGS for x in (F.col(f), whole(f, "n").alias(f"{f}_rate"))]
    cols += [share(f"_{c}_n", f"_{c}_den").alias(f"{c}_rate") for c in ("answer_correct", "answer_correct_strict")]
    method = F.lower(T.strip(T.text(F.col("_first.retrieval_method"))))
    cols += [F.when(method == "sparce", "sparse").otherwise(method).alias(m) if m == "retrieval_method" else F.col(f"_first.{m}").alias(m) for m in METADATA]
    cols += [c.alias(n) for n, c in refusal_metrics(*(F.col(x) for x in ("tp", "fp", "tn", "fn"))).items()]
    cols += [x for t in REFUSAL_TYPES for x in (F.col(f"refuse_n__{t}"), F.col(f"refuse_refused__{t}"), share(f"refuse_refused__{t}", f"refuse_n__{t}").alias(f"refuse_refused_rate__{t}"))]
    for s in SLICES:
        n = f"slice_n__{s}"
        cols += [F.col(n), share(f"_over__{s}", n).alias(f"slice_over_refusal_rate__{s}")]
        cols += [share(f"_{f}__{s}", n).alias(f"slice_{f.removesuffix('_non_refusal')}_rate__{s}") for f in FLAGS]
        cols += [share(f"_strict__{s}", f"_den__{s}").alias(f"slice_strict_correct_rate__{s}")]
    by_type = refusal_by_type(log, run).withColumnRenamed("rate", "refused_rate")
    entries = F.array_sort(F.collect_list(F.struct("refusal_type", F.struct("n", "refused", "refused_rate"))))
    breakdown = by_type.groupBy(run).agg(F.to_json(F.map_from_entries(entries)).alias("refusal_type_breakdown"))
    out = g.select(*cols).join(breakdown, run, "left")
    return out if runs is None else runs.join(out, run, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def conditional_refusal(log: DataFrame, run: str = "run", order: str = "_ord") -> DataFrame:
    """One row per run: P(refusal | hit) of four kinds of hit, two gaps, and the counts of all categories.

    Rows without a refusal finding, label or hit are left out; a run with none of the others gives no row.
    Ratios are exact; rounding is for reports.
    """
    seen = F.col("model_refused").isNotNull() & F.col("should_refuse").isNotNull() & F.coalesce("any_hit", "retrieval_hit").isNotNull()
    full, partial = false_if_null(F.col("full_hit")), false_if_null(F.col("partial_hit"))
    category = refusal_category(hit(), full, partial, F.col("should_refuse"), F.col("model_refused"))
    log = log.withColumns({"_seen": seen, "_category": F.when(seen, category)})
    slices = {"any_hit": hit(), "no_hit": ~hit(), "partial_hit": partial, "full_hit": full}
    meta = [m for m in METADATA if m != "system_prompt_sha256"]
    aggs = [F.min_by(F.struct(*meta), order).alias("_first"), F.count_if("_seen").alias("n_rows")]
    for s, w in slices.items():
        aggs += [F.count_if(F.col("_seen") & w).alias(f"{s}_n"), F.count_if(F.col("_seen") & w & F.col("model_refused")).alias(f"{s}_refuse_n")]
    aggs += [F.count_if(F.col("_category") == c).alias(c) for c in CATEGORIES]
    g = log.groupBy(run).agg(*aggs).filter("n_rows > 0")
    p = {s: F.try_divide(F.col(f"{s}_refuse_n").cast("double"), F.col(f"{s}_n").cast("double")) for s in slices}
    return g.select(
        run, *[F.col(f"_first.{m}").alias(m) for m in meta], "n_rows", *[f"{s}_{x}" for s in slices for x in ("n", "refuse_n")],
        *[p[s].alias(f"p_refusal_{s}") for s in slices], (p["no_hit"] - p["any_hit"]).alias("gap_nohit_minus_anyhit"),
        (p["partial_hit"] - p["full_hit"]).alias("gap_partial_minus_full"), *CATEGORIES,
    )


def _order() -> list[Column]:
    return [F.coalesce("model", F.lit("")), F.coalesce("retrieval_method", F.lit("")), F.coalesce("top_k", F.lit(-1))]


def order_runs(summary: DataFrame) -> DataFrame:
    """Runs by model, method and top_k; missing top_k first."""
    return summary.orderBy(*_order())


def with_positions(summary: DataFrame) -> DataFrame:
    """Adds each run's position in that order, as a column; a row is a run, so that they are few."""
    return summary.withColumn("position", F.rank().over(W.orderBy(*_order())))


def last_by_id(log: DataFrame, ident: str = "id", order: str = "_ord") -> DataFrame:
    """The last row of each id that isn't blank; ids are stripped."""
    return last_wins(log.withColumn(ident, T.strip(F.col(ident))), ident, order)


def recall_at_k(log: DataFrame, run: str = "run") -> DataFrame:
    """(run, n, any_hit_recall, full_hit_recall) over questions with targets."""
    with_targets = log.filter(F.size(F.coalesce("target_sections", F.array().cast("array<string>"))) > 0)
    return with_targets.groupBy(run).agg(F.count("*").alias("n"), F.avg(F.col("any_hit").cast("int")).alias("any_hit_recall"), F.avg(F.col("full_hit").cast("int")).alias("full_hit_recall"))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    fields = ["question", "should_refuse", "model_refused", "status", "model", "full_hit", "partial_hit"]
    # Only what is compared goes into the choice of the last row.
    one = lambda df, p: last_by_id(df.select("id", "_ord", *[F.col(f).alias(f"{p}_{f}") for f in fields], F.coalesce("any_hit", "retrieval_hit").alias(f"{p}_any_hit"))).drop("_ord")
    return one(a, "a").join(one(b, "b"), "id")


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, delta) over the ids that both runs have; failed items count only for query_failed_rate."""
    both = _both(a, b)
    aggs = [F.count("*").alias("common")]
    for p in "ab":
        ok = ~F.coalesce(F.col(f"{p}_status") == "query_failed", F.lit(False))
        aggs += [c.alias(f"{p}_{n}") for n, c in confusion(F.col(f"{p}_should_refuse"), F.col(f"{p}_model_refused"), ok).items()]
        aggs += [F.count_if(ok & false_if_null(F.col(f"{p}_{h}_hit"))).alias(f"{p}_{h}") for h in ("any", "full", "partial")] + [F.count_if(~ok).alias(f"{p}_failed")]
    g = both.agg(*aggs)
    rows = []
    for n in ("total", "accuracy", "precision", "recall", "specificity", "f1", "refusal_rate_pred", "any_hit_rate", "full_hit_rate", "partial_hit_rate", "query_failed_rate"):
        v = []
        for p in "ab":
            m = [F.col(f"{p}_{x}") for x in ("tp", "fp", "tn", "fn")]
            total = m[0] + m[1] + m[2] + m[3]
            kind = n.removesuffix("_rate").removesuffix("_hit")
            v.append(total.cast("double") if n == "total" else T.safe_div(F.col(f"{p}_failed"), F.col("common")) if kind == "query_failed" else T.safe_div(F.col(f"{p}_{kind}"), total) if kind in ("any", "full", "partial") else refusal_metrics(*m)[n])
        rows.append(F.struct(F.lit(n).alias("metric"), v[0].alias("a"), v[1].alias("b"), (v[1] - v[0]).alias("delta")))
    return g.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def refusal_flips(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items that only one of two runs refused; a missing finding counts as an answer."""
    flipped = false_if_null(F.col("a_model_refused")) != false_if_null(F.col("b_model_refused"))
    question = F.coalesce(T.blank_to_null(F.col("a_question")), T.strip(T.text(F.col("b_question"))))
    sides = [F.col(f"{p}_{f}") for f in ("any_hit", "full_hit", "partial_hit", "status", "model") for p in "ab"]
    return _both(a, b).filter(flipped).select(
        "id", question.alias("question"), false_if_null(F.col("a_should_refuse")).alias("should_refuse"),
        false_if_null(F.col("a_model_refused")).alias("a_model_refused"), false_if_null(F.col("b_model_refused")).alias("b_model_refused"), *sides,
    )


def flip_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(refusal_flips, any_hit_flips, full_hit_flips, partial_hit_flips) over common ids."""
    differs = lambda f: F.count_if(false_if_null(F.col(f"a_{f}")) != false_if_null(F.col(f"b_{f}")))
    return _both(a, b).agg(differs("model_refused").alias("refusal_flips"), *[differs(f).alias(f"{f}_flips") for f in ("any_hit", "full_hit", "partial_hit")])


def pairwise_runs(summary: DataFrame, metrics: list[str], index: str = "run_idx") -> DataFrame:
    """Deltas of metrics between each run and the next one by index."""
    later = summary.select((F.col(index) - 1).alias(index), F.col("run").alias("run_b"), *[F.col(m).alias(f"_b_{m}") for m in metrics])
    return summary.join(later, index).select(index, F.col("run").alias("run_a"), "run_b", *[(F.col(f"_b_{m}") - F.col(m)).alias(f"delta_{m}") for m in metrics])
