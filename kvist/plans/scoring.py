"""Queries of item scoring and of the analysis of runs. The two run logs count as two runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvist.functions import text as T
from kvist.functions.metrics import wilson
from kvist.operators import answering as A
from kvist.operators import evaluation as E
from kvist.operators import summaries as S
from kvist.plans import duck as D
from kvist.plans.registry import Catalogue
from kvist.session import table

CATALOGUE = Catalogue()
_RUNS = "runs AS (SELECT 'a' AS run, * FROM run_log_a UNION ALL BY NAME SELECT 'b' AS run, * FROM run_log_b)"
_OK = "coalesce(status <> 'query_failed', true)"
_SHOULD, _REFUSED = "coalesce(should_refuse, false)", "coalesce(model_refused, false)"
_HIT = "coalesce(any_hit, retrieval_hit, false)"
CELLS = {"tp": f"{_SHOULD} AND {_REFUSED}", "fp": f"NOT {_SHOULD} AND {_REFUSED}", "tn": f"NOT {_SHOULD} AND NOT {_REFUSED}", "fn": f"{_SHOULD} AND NOT {_REFUSED}"}
METRICS = list(D.metrics())


def runs_of(spark, folder):
    a, b = (table(spark, folder, f"run_log_{x}").withColumn("run", F.lit(x)) for x in "ab")
    return a.unionByName(b)


def _round(df, *names, digits=6):
    return df.select([(F.round(c, digits) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


def cells_sql(where: str = "true", prefix: str = "") -> str:
    return ", ".join(f"count(*) FILTER (WHERE {_OK} AND ({where}) AND {w}) AS {prefix}{n}" for n, w in CELLS.items())


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


@CATALOGUE.query("section_normalize", f"SELECT _ord, array_to_string({D.section_set('target_sections')}, '|') AS targets, array_to_string({D.chapters('target_sections')}, '|') AS chapters FROM tek17_eval_questions")
def section_normalize(spark, folder):
    return table(spark, folder, "tek17_eval_questions").select("_ord", F.array_join(T.section_set(F.col("target_sections")), "|").alias("targets"), F.array_join(T.target_chapters(F.col("target_sections")), "|").alias("chapters"))


@CATALOGUE.query("item_cleaning", f"""
SELECT _ord, {D.strip('question')} AS question, nullif({D.strip('question_type')}, '') AS question_type, nullif({D.strip('refusal_type')}, '') AS refusal_type, coalesce(should_refuse, false) AS should_refuse
FROM tek17_eval_questions WHERE {D.strip('question')} <> ''""")
def item_cleaning(spark, folder):
    return E.clean_items(table(spark, folder, "tek17_eval_questions")).select("_ord", "question", "question_type", "refusal_type", "should_refuse")


@CATALOGUE.query("question_types", f"""
SELECT _ord, CASE WHEN {D.strip('question_type')} <> '' AND _ord % 2 = 0 THEN {D.strip('question_type')} WHEN {_SHOULD} THEN 'refusal' WHEN coalesce(len(target_sections), 0) >= 2 OR coalesce(contains(id, '_multi_'), false) THEN 'in_scope_multi' ELSE 'in_scope_single' END AS kind FROM tek17_eval_questions""")
def question_types(spark, folder):
    """The type of each question, told from its other fields for every second one."""
    stated = F.when(F.col("_ord") % 2 == 0, F.col("question_type"))
    return table(spark, folder, "tek17_eval_questions").select("_ord", T.question_type(stated, F.col("should_refuse"), F.col("target_sections"), F.col("id")).alias("kind"))


_TOLD = f"CASE WHEN {_SHOULD} THEN 'refusal' WHEN coalesce(len(target_sections), 0) >= 2 OR coalesce(contains(id, '_multi_'), false) THEN 'in_scope_multi' ELSE 'in_scope_single' END"


@CATALOGUE.query("question_types_all", f"SELECT _ord, CASE WHEN {D.strip('question_type')} <> '' THEN {D.strip('question_type')} ELSE {_TOLD} END AS kind, {_TOLD} AS told FROM tek17_eval_questions")
def question_types_all(spark, folder):
    """The type of each question, and the type told from its other fields alone, for all questions."""
    of = lambda stated: T.question_type(stated, F.col("should_refuse"), F.col("target_sections"), F.col("id"))
    return table(spark, folder, "tek17_eval_questions").select("_ord", of(F.col("question_type")).alias("kind"), of(F.lit(None).cast("string")).alias("told"))


_T, _G = D.section_set("target_sections"), D.section_set("retrieved_section_ids")
_COVER = f"""cov AS (SELECT *, {_T} AS t, {_G} AS g, coalesce(requires_qualification, false) AS need FROM runs),
hits AS (SELECT *, len(t) > 0 AND list_has_any(t, g) AS a_hit, CASE WHEN need THEN len(t) > 0 AND list_has_any(t, g) ELSE len(t) > 0 AND list_has_all(g, t) END AS f_hit FROM cov),
hit3 AS (SELECT *, NOT need AND a_hit AND NOT f_hit AS p_hit FROM hits)"""


@CATALOGUE.query("coverage_hits", f"WITH {_RUNS}, {_COVER} SELECT run, _ord, a_hit AS any_hit, f_hit AS full_hit, p_hit AS partial_hit FROM hit3")
def coverage_hits(spark, folder):
    return E.coverage(runs_of(spark, folder)).select("run", "_ord", "any_hit", "full_hit", "partial_hit")


_ANS = "lower(coalesce(answer, ''))"
_TAG = f"contains({_ANS}, 'kan_ikke_svare')"
_BARE = D.strip(_ANS)
_CLASS = f"({_BARE} = '' OR {_TAG} OR " + " OR ".join(f"starts_with({_BARE}, '{p}')" for p in T.REFUSAL_BEGINNINGS) + ")"
_WARN = "(" + " OR ".join(f"contains({_ANS}, '{p}')" for p in T.QUALIFICATION_PHRASES) + ")"


@CATALOGUE.query("refusal_flags", f"WITH {_RUNS} SELECT run, _ord, {_TAG} AS tagged, {_CLASS} AS heuristic, {_WARN} AS warned FROM runs")
def refusal_flags(spark, folder):
    a = F.col("answer")
    return runs_of(spark, folder).select("run", "_ord", T.has_refusal_tag(a).alias("tagged"), T.classify_refusal(a).alias("heuristic"), T.has_qualification_warning(a).alias("warned"))


_CTX = "array_to_string(list_transform(coalesce(sources, []), lambda z: coalesce(z.text, '')), chr(10))"
_OWN, _THEIR = D.content_words("answer", T.CONTENT_STOPWORDS), D.content_words(_CTX, T.CONTENT_STOPWORDS)
_GROUND = f"CASE WHEN len({_OWN}) > 0 AND len({_THEIR}) > 0 THEN len(list_intersect({_OWN}, {_THEIR}))::DOUBLE / len({_OWN}) ELSE 0 END"


@CATALOGUE.query("groundedness", f"WITH {_RUNS} SELECT run, _ord, {_r(_GROUND)} AS score FROM runs")
def groundedness(spark, folder):
    return _round(runs_of(spark, folder).select("run", "_ord", T.groundedness(F.col("answer"), F.col("sources")).alias("score")), "score")


_SCORED = f"""{_COVER},
fl AS (SELECT *, status IS DISTINCT FROM 'query_failed' AND error IS NULL AS ok, {_SHOULD} AS sh, {_TAG} AS tagged, {_CLASS} AS heur, {_WARN} AS warned, {_GROUND} AS gr FROM hit3),
rf AS (SELECT *, CASE WHEN need AND a_hit AND warned THEN false ELSE tagged OR heur END AS rf FROM fl),
sc AS (SELECT *, CASE WHEN sh THEN rf WHEN rf THEN false WHEN need THEN f_hit AND warned ELSE f_hit END AS corr,
    CASE WHEN sh AND rf THEN 'correct_refusal' WHEN sh THEN 'under_refusal' WHEN rf THEN 'over_refusal'
        WHEN need AND NOT a_hit THEN 'unsupported_qualified_answer' WHEN need AND NOT warned THEN 'missing_qualification_warning'
        WHEN need AND f_hit AND gr < 0.25 THEN 'ungrounded_qualified_answer' WHEN need THEN 'correct_qualified_answer'
        WHEN NOT a_hit THEN 'unsupported_answer' WHEN p_hit THEN 'partial_support_answer' WHEN f_hit AND gr < 0.25 THEN 'ungrounded_answer' ELSE 'correct_answer' END AS st FROM rf)"""


@CATALOGUE.query("item_scores", f"""WITH {_RUNS}, {_SCORED}
SELECT run, _ord, CASE WHEN error IS NULL THEN st ELSE 'query_failed' END AS status, CASE WHEN error IS NULL THEN rf END AS model_refused, error IS NULL AND corr AS answer_correct,
    error IS NULL AND CASE WHEN sh OR rf THEN corr ELSE corr AND gr >= 0.25 END AS answer_correct_strict, error IS NULL AND NOT sh AND NOT rf AND NOT a_hit AS unsupported_non_refusal,
    error IS NULL AND NOT sh AND NOT rf AND p_hit AS partial_support_non_refusal, error IS NULL AND NOT sh AND NOT rf AND f_hit AND gr < 0.25 AS ungrounded_non_refusal,
    CASE WHEN error IS NULL AND NOT sh AND NOT rf THEN f_hit END AS answer_supported FROM sc""")
def item_scores(spark, folder):
    scored = E.score_answers(E.coverage(runs_of(spark, folder)))
    return scored.select("run", "_ord", "status", "model_refused", "answer_correct", "answer_correct_strict", "unsupported_non_refusal", "partial_support_non_refusal", "ungrounded_non_refusal", "answer_supported")


def _category_sql(full: bool) -> str:
    a, f, p, s, r = _HIT, "coalesce(full_hit, false)", "coalesce(partial_hit, false)", _SHOULD, _REFUSED
    n, w = ("coalesce(requires_qualification, false)", "coalesce(qualification_warning_present, false)") if full else ("false", "false")
    return f"""CASE WHEN {n} AND NOT {s} AND NOT {r} THEN CASE WHEN NOT {a} THEN 'answer_without_evidence' WHEN NOT {w} THEN 'missing_qualification_warning' ELSE 'correct_qualified_answer' END
        WHEN NOT {a} AND {s} AND {r} THEN 'retrieval_miss_correct_refusal' WHEN {p} AND NOT {s} AND {r} THEN 'over_refusal_with_partial_evidence' WHEN {f} AND NOT {s} AND {r} THEN 'over_refusal_with_full_evidence'
        WHEN NOT {a} AND NOT {s} AND NOT {r} THEN 'answer_without_evidence' WHEN {p} AND NOT {s} AND NOT {r} THEN 'partial_support_answer' WHEN {f} AND NOT {s} AND NOT {r} THEN 'correct_answer'
        WHEN {p} AND {s} AND {r} THEN 'correct_refusal_with_partial_context' WHEN {f} AND {s} AND {r} THEN 'correct_refusal_with_full_context'
        WHEN {p} AND {s} AND NOT {r} THEN 'under_refusal_with_partial_context' WHEN {f} AND {s} AND NOT {r} THEN 'under_refusal_with_full_context'
        WHEN NOT {a} AND {s} AND NOT {r} THEN 'unsafe_answer_no_evidence' ELSE 'other' END"""


@CATALOGUE.query("refusal_categories", f"WITH {_RUNS} SELECT run, _ord, {_category_sql(False)} AS category, {_category_sql(True)} AS category_full FROM runs")
def refusal_categories(spark, folder):
    z = E.false_if_null
    base = (S.hit(), z(F.col("full_hit")), z(F.col("partial_hit")), z(F.col("should_refuse")), z(F.col("model_refused")))
    full = E.refusal_category(*base, z(F.col("requires_qualification")), z(F.col("qualification_warning_present")))
    return runs_of(spark, folder).select("run", "_ord", E.refusal_category(*base).alias("category"), full.alias("category_full"))


@CATALOGUE.query("confusion", f"WITH {_RUNS} SELECT run, {cells_sql()} FROM runs GROUP BY run")
def confusion(spark, folder):
    return S.confusion_matrix(runs_of(spark, folder))


_SLICES = {"any_hit": _HIT, "no_hit": f"NOT {_HIT}", "full_hit": "coalesce(full_hit, false)", "partial_hit": "coalesce(partial_hit, false)"}


@CATALOGUE.query("sliced_confusion", f"WITH {_RUNS} " + " UNION ALL ".join(f"SELECT run, '{s}' AS slice, {cells_sql(w)} FROM runs GROUP BY run" for s, w in _SLICES.items()))
def sliced_confusion(spark, folder):
    return S.sliced_confusion(runs_of(spark, folder))


@CATALOGUE.query("refusal_metrics", f"WITH {_RUNS}, m AS (SELECT run, {cells_sql()} FROM runs GROUP BY run) SELECT run, tp, fp, tn, fn, " + ", ".join(f"{_r(x)} AS {n}" for n, x in D.metrics().items()) + " FROM m")
def refusal_metrics(spark, folder):
    return _round(S.with_metrics(S.confusion_matrix(runs_of(spark, folder))), *METRICS)


_RATES = {"accuracy": f"{_OK} AND {_SHOULD} = {_REFUSED}", "correct": "coalesce(answer_correct, false)", "strict": "coalesce(answer_correct_strict, false)"}


@CATALOGUE.query("rates_with_intervals", f"WITH {_RUNS}, m AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE NOT {_OK}) AS query_failed, " + ", ".join(f"count(*) FILTER (WHERE {w}) AS {k}_n" for k, w in _RATES.items()) + " FROM runs GROUP BY run) SELECT run, n, query_failed, "
    + ", ".join(f"{_r(f'{k}_n::DOUBLE / n')} AS {k}, {_r(D.wilson(f'{k}_n', 'n')[0])} AS {k}_low, {_r(D.wilson(f'{k}_n', 'n')[1])} AS {k}_high" for k in _RATES) + " FROM m")
def rates_with_intervals(spark, folder):
    return _round(S.rates_with_intervals(runs_of(spark, folder)), *[f"{k}{x}" for k in _RATES for x in ("", "_low", "_high")])


@CATALOGUE.query("wilson_intervals", f"SELECT k, n, {_r(D.wilson('k', 'n')[0])} AS low, {_r(D.wilson('k', 'n')[1])} AS high FROM (SELECT top_k::BIGINT AS n, unnest(range(0, top_k::BIGINT + 1)) AS k FROM (SELECT DISTINCT top_k FROM run_log_a WHERE top_k IS NOT NULL))")
def wilson_intervals(spark, folder):
    """Intervals of all shares with the run log's values of top_k as number of trials."""
    n = table(spark, folder, "run_log_a").select(F.col("top_k").cast("bigint").alias("n")).filter("n IS NOT NULL").distinct()
    low, high = wilson(F.col("k"), F.col("n"))
    return _round(n.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n"))).alias("k")).select("k", "n", low.alias("low"), high.alias("high")), "low", "high")


_TYPE = f"coalesce(nullif({D.strip('refusal_type')}, ''), '(unspecified)')"


@CATALOGUE.query("refusal_by_type", f"WITH {_RUNS} SELECT run, {_TYPE} AS refusal_type, count(*) AS n, count(*) FILTER (WHERE {_REFUSED}) AS refused, {_r(f'count(*) FILTER (WHERE {_REFUSED})::DOUBLE / count(*)')} AS rate FROM runs WHERE {_OK} AND {_SHOULD} GROUP BY ALL")
def refusal_by_type(spark, folder):
    return _round(S.refusal_by_type(runs_of(spark, folder)), "rate")


_QT = f"CASE WHEN {D.strip('question_type')} <> '' THEN {D.strip('question_type')} WHEN {_SHOULD} THEN 'refusal' WHEN coalesce(len(target_sections), 0) >= 2 OR coalesce(contains(id, '_multi_'), false) THEN 'in_scope_multi' ELSE 'in_scope_single' END"


def _summary_sql() -> str:
    c = lambda w: f"count(*) FILTER (WHERE {w})"
    n, ok = "count(*)", c(_OK)
    cols = [f"{n} AS n", f"{ok} AS n_ok", f"{c('NOT ' + _OK)} AS n_errors", f"{_r(D.div(c('NOT ' + _OK), n))} AS error_rate", cells_sql()]
    hits = {"any": _HIT, "full": "coalesce(full_hit, false)", "partial": "coalesce(partial_hit, false)", "retrieval": _HIT}
    cols += [f"{_r(D.div(c(f'{_OK} AND {w}'), ok))} AS {h}_hit_rate" for h, w in hits.items()]
    for f in S.FLAGS:
        cols += [f"{c(f'coalesce({f}, false)')} AS {f}", f"{_r(D.div(c(f'coalesce({f}, false)'), n))} AS {f}_rate"]
    share = lambda a, b: f"round(({c(a)})::DOUBLE / nullif({c(b)}, 0), 6) + 0.0"
    cols += [f"{share(f'{_OK} AND coalesce({x}, false)', f'{_OK} AND {x} IS NOT NULL')} AS {x}_rate" for x in ("answer_correct", "answer_correct_strict")]
    cols += [f"arg_min({m}, _ord) AS {m}" for m in ("model", "top_k")]
    cols += [f"{_r(x)} AS {m}" for m, x in D.metrics(*(c(f"{_OK} AND {w}") for w in CELLS.values())).items()]
    for t in S.REFUSAL_TYPES:
        w = f"{_OK} AND {_SHOULD} AND {_TYPE} = '{t}'"
        cols += [f'{c(w)} AS "refuse_n__{t}"', f'{c(f"{w} AND {_REFUSED}")} AS "refuse_refused__{t}"', f'{share(f"{w} AND {_REFUSED}", w)} AS "refuse_refused_rate__{t}"']
    for s in S.SLICES:
        w = f"{_OK} AND NOT {_SHOULD} AND {_QT} = '{s}'"
        cols += [f"{c(w)} AS slice_n__{s}", f"{share(f'{w} AND {_REFUSED}', w)} AS slice_over_refusal_rate__{s}"]
        cols += [f"{share(f'{w} AND coalesce({f}, false)', w)} AS slice_{f.removesuffix('_non_refusal')}_rate__{s}" for f in S.FLAGS]
        cols += [f"{share(f'{w} AND coalesce(answer_correct_strict, false)', f'{w} AND answer_correct_strict IS NOT NULL')} AS slice_strict_correct_rate__{s}"]
    return f"WITH {_RUNS} SELECT run, {', '.join(cols)} FROM runs GROUP BY run"


@CATALOGUE.query("run_summary", _summary_sql())
def run_summary(spark, folder):
    out = S.run_summary(runs_of(spark, folder)).drop("mode", "temperature", "retrieval_method", "hybrid_alpha", "prompt_version", "system_prompt_sha256", "refusal_type_breakdown")
    return _round(out, *[f.name for f in out.schema.fields if f.dataType.typeName() == "double"])


@CATALOGUE.query("run_summary_breakdown", f"""WITH {_RUNS},
f AS (SELECT run, arg_min(struct_pack(mode, model, retrieval_method, prompt_version, top_k), _ord) AS m FROM runs GROUP BY run),
t AS (SELECT run, {_TYPE} AS kind, count(*) AS n, count(*) FILTER (WHERE {_REFUSED}) AS refused FROM runs WHERE {_OK} AND {_SHOULD} GROUP BY ALL),
j AS (SELECT run, '{{' || string_agg('"' || kind || '":{{"n":' || n || ',"refused":' || refused || ',"refused_rate":' || (refused::DOUBLE / n)::VARCHAR || '}}', ',' ORDER BY kind) || '}}' AS breakdown FROM t GROUP BY run)
SELECT run, m.mode AS mode, m.model AS model, replace(lower(coalesce(m.retrieval_method, '')), 'sparce', 'sparse') AS retrieval_method, m.prompt_version AS prompt_version, breakdown AS refusal_type_breakdown,
    rank() OVER (ORDER BY coalesce(m.model, ''), replace(lower(coalesce(m.retrieval_method, '')), 'sparce', 'sparse'), coalesce(m.top_k, -1)) AS position FROM f LEFT JOIN j USING (run)""")
def run_summary_breakdown(spark, folder):
    out = S.with_positions(S.run_summary(runs_of(spark, folder)))
    return out.select("run", "mode", "model", "retrieval_method", "prompt_version", "refusal_type_breakdown", F.col("position").cast("bigint").alias("position"))


def _conditional_sql() -> str:
    c = lambda w: f"count(*) FILTER (WHERE {w})"
    seen = "model_refused IS NOT NULL AND should_refuse IS NOT NULL AND coalesce(any_hit, retrieval_hit) IS NOT NULL"
    cols, p = [f"{c(seen)} AS n_rows"], {}
    for s, w in _SLICES.items():
        cols += [f"{c(f'{seen} AND {w}')} AS {s}_n", f"{c(f'{seen} AND {w} AND model_refused')} AS {s}_refuse_n"]
        p[s] = f"({c(f'{seen} AND {w} AND model_refused')})::DOUBLE / nullif({c(f'{seen} AND {w}')}, 0)"
    cols += [f"round({x}, 6) + 0.0 AS p_refusal_{s}" for s, x in p.items()]
    cols += [f"round({p['no_hit']} - {p['any_hit']}, 6) + 0.0 AS gap_nohit_minus_anyhit", f"round({p['partial_hit']} - {p['full_hit']}, 6) + 0.0 AS gap_partial_minus_full"]
    cols += [f"{c(f'{seen} AND {_category_sql(False)} = {chr(39)}{x}{chr(39)}')} AS {x}" for x in E.CATEGORIES]
    return f"WITH {_RUNS} SELECT run, {', '.join(cols)} FROM runs GROUP BY run HAVING {c(seen)} > 0"


@CATALOGUE.query("conditional_refusal", _conditional_sql())
def conditional_refusal(spark, folder):
    out = S.conditional_refusal(runs_of(spark, folder)).drop("mode", "model", "temperature", "top_k", "retrieval_method", "hybrid_alpha", "prompt_version")
    return _round(out, *[f.name for f in out.schema.fields if f.dataType.typeName() == "double"])


def _last(x: str) -> str:
    return f"{x} AS (SELECT {D.strip('id')} AS k, * FROM run_log_{x} WHERE {D.strip('id')} <> '' QUALIFY row_number() OVER (PARTITION BY {D.strip('id')} ORDER BY _ord DESC) = 1)"


@CATALOGUE.query("last_row_by_id", f"WITH {_last('a')} SELECT k AS id, _ord, status FROM a")
def last_row_by_id(spark, folder):
    return S.last_by_id(table(spark, folder, "run_log_a").select("id", "_ord", "status"))


def _compare_sql() -> str:
    parts = []
    for x in "ab":
        cells = ", ".join(f"count(*) FILTER (WHERE {_OK} AND {w}) AS {n}" for n, w in CELLS.items())
        hits = ", ".join(f"count(*) FILTER (WHERE {_OK} AND {w}) AS {n}" for n, w in (("h_any", _HIT), ("h_full", "coalesce(full_hit, false)"), ("h_partial", "coalesce(partial_hit, false)")))
        parts.append(f"m{x} AS (SELECT {cells}, {hits}, count(*) FILTER (WHERE NOT {_OK}) AS failed, count(*) AS common FROM {x} WHERE k IN (SELECT k FROM {'b' if x == 'a' else 'a'}))")
    m, total = D.metrics(), "(tp + fp + tn + fn)"
    values = {"total": f"{total}::DOUBLE"} | {n: m[n] for n in ("accuracy", "precision", "recall", "specificity", "f1", "refusal_rate_pred")}
    values |= {f"{h}_hit_rate": D.div(f"h_{h}", total) for h in ("any", "full", "partial")} | {"query_failed_rate": D.div("failed", "common")}
    rows = " UNION ALL ".join(f"SELECT '{n}' AS metric, (SELECT {v} FROM ma) AS x, (SELECT {v} FROM mb) AS y" for n, v in values.items())
    return f"WITH {_last('a')}, {_last('b')}, {', '.join(parts)} SELECT metric, {_r('x')} AS a, {_r('y')} AS b, {_r('y - x')} AS delta FROM ({rows})"


@CATALOGUE.query("compare_runs", _compare_sql())
def compareruns_of(spark, folder):
    return _round(S.compare_runs(table(spark, folder, "run_log_a"), table(spark, folder, "run_log_b")), "a", "b", "delta")


@CATALOGUE.query("refusal_flips", f"""WITH {_last('a')}, {_last('b')}
SELECT a.k AS id, coalesce(nullif({D.strip('a.question')}, ''), {D.strip("coalesce(b.question, '')")}) AS question, coalesce(a.should_refuse, false) AS should_refuse, coalesce(a.model_refused, false) AS a_model_refused, coalesce(b.model_refused, false) AS b_model_refused,
    coalesce(a.any_hit, a.retrieval_hit) AS a_any_hit, coalesce(b.any_hit, b.retrieval_hit) AS b_any_hit, a.full_hit AS a_full_hit, b.full_hit AS b_full_hit, a.partial_hit AS a_partial_hit, b.partial_hit AS b_partial_hit,
    a.status AS a_status, b.status AS b_status, a.model AS a_model, b.model AS b_model FROM a JOIN b USING (k) WHERE coalesce(a.model_refused, false) <> coalesce(b.model_refused, false)""")
def refusal_flips(spark, folder):
    return S.refusal_flips(table(spark, folder, "run_log_a"), table(spark, folder, "run_log_b"))


@CATALOGUE.query("flip_counts", f"""WITH {_last('a')}, {_last('b')} SELECT """ + ", ".join(f"count(*) FILTER (WHERE coalesce({x.format('a')}, false) <> coalesce({x.format('b')}, false)) AS {n}_flips" for n, x in (
    ("refusal", "{0}.model_refused"), ("any_hit", "coalesce({0}.any_hit, {0}.retrieval_hit)"), ("full_hit", "{0}.full_hit"), ("partial_hit", "{0}.partial_hit"))) + " FROM a JOIN b USING (k)")
def flip_counts(spark, folder):
    return S.flip_counts(table(spark, folder, "run_log_a"), table(spark, folder, "run_log_b"))


_MODELS = f"m AS (SELECT coalesce(model, '') AS run, {cells_sql()} FROM runs GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY run) AS run_idx, {D.metrics()['accuracy']} AS acc, {D.metrics()['f1']} AS f1 FROM m)"


@CATALOGUE.query("pairwise_runs", f"WITH {_RUNS}, {_MODELS} SELECT x.run_idx, x.run AS run_a, y.run AS run_b, {_r('y.acc - x.acc')} AS delta_accuracy, {_r('y.f1 - x.f1')} AS delta_f1 FROM i x JOIN i y ON y.run_idx = x.run_idx + 1")
def pairwiseruns_of(spark, folder):
    """Each model's run against the next one's."""
    from pyspark.sql import Window as W

    by_model = runs_of(spark, folder).withColumn("run", F.coalesce("model", F.lit("")))
    summary = S.with_metrics(S.confusion_matrix(by_model)).withColumn("run_idx", F.row_number().over(W.orderBy("run")).cast("bigint"))
    return _round(S.pairwise_runs(summary, ["accuracy", "f1"]), "delta_accuracy", "delta_f1")


@CATALOGUE.query("sweep_grid", """SELECT prompt_version, top_k, retrieval_method, hybrid_alpha, temperature, count(*) AS n FROM (
    SELECT p AS prompt_version, k::INT AS top_k, m AS retrieval_method, CASE WHEN m = 'hybrid' THEN a ELSE 0.25 END AS hybrid_alpha, t AS temperature
    FROM (SELECT unnest(['baseline', 'strict']) AS p), (SELECT unnest([6, 14]) AS k), (SELECT unnest(['dense', 'sparse', 'hybrid']) AS m), (SELECT unnest([0.25, 0.5])::DOUBLE AS a), (SELECT unnest([0.0, 0.7])::DOUBLE AS t)
    WHERE m = 'hybrid' OR a = 0.25) GROUP BY ALL""")
def sweep_grid(spark, folder):
    from kvist.operators.sweep import grid, grid_table

    runs = grid(1, ["baseline", "strict"], [6, 14], ["dense", "sparce", "hybrid"], [0.25, 0.5], [0.0, 0.7])
    return grid_table(spark, runs).groupBy("prompt_version", "top_k", "retrieval_method", "hybrid_alpha", "temperature").agg(F.count("*").alias("n"))


@CATALOGUE.query("answer_batch")
def answer_batch(spark, folder):
    """Questions whose _ord is divisible by 100, asked of the whole chunk table with the offline providers."""
    from kvist.config import Settings
    from kvist.operators.answering import run_questions
    from kvist.providers import embed_column, hashing_embedder

    chunks = table(spark, folder, "tek17_chunks").select(T.fusion_key(F.col("text"), F.col("metadata")).alias("key"), F.col("_ord").alias("ord"), "text", "metadata")
    collection = embed_column(chunks.select(F.col("ord").alias("id"), "key", F.col("text").alias("document"), "metadata"), "document", hashing_embedder())
    q = table(spark, folder, "tek17_eval_questions").filter("_ord % 100 = 0")
    return run_questions(q, collection, chunks, Settings(retrieval_method="hybrid"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_NEED = "coalesce(requires_qualification, false)"


@CATALOGUE.query("prompts", f"""SELECT _ord, v AS version, sha256(CASE trim(lower(v)) WHEN 'relaxed' THEN {_quoted(A.PROMPTS['relaxed'])} WHEN 'strict' THEN {_quoted(A.PROMPTS['strict'])} ELSE {_quoted(A.PROMPTS['baseline'])} END
    || CASE WHEN {_NEED} THEN {_quoted(A.QUALIFICATION)} ELSE '' END) AS system_sha256,
    md5('Kontekst:' || chr(10) || chr(10) || coalesce(notes, '') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN {_NEED} THEN {_quoted(A.QUALIFICATION.strip())} || chr(10) || chr(10) ELSE '' END || 'Spørsmål: ' || question) AS user_md5
FROM tek17_eval_questions, (SELECT unnest(['baseline', ' Relaxed', 'strict', 'unknown']) AS v)""")
def prompts(spark, folder):
    """System prompts' fingerprints and user messages of all questions under four versions."""
    q = table(spark, folder, "tek17_eval_questions").withColumn("version", F.explode(F.array(*map(F.lit, ("baseline", " Relaxed", "strict", "unknown")))))
    need = F.col("requires_qualification")
    return q.select("_ord", "version", A.prompt_fingerprint(A.system_prompt(F.col("version"), need)).alias("system_sha256"), F.md5(A.user_message(F.col("notes"), F.col("question"), need)).alias("user_md5"))
