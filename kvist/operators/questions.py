"""Question sets made from provisions: sections, seeded draws, single and multi-section items, items to refuse.

Draws follow a hash of the section and the seed, so that they don't depend on partitions; they differ from
those of a sequential random generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kvist.functions.text import difficulty, keywords, strip, text, topic_variants
from kvist.sources.records import last_wins

ITEM = ["id", "question_type", "question", "target_sections", "difficulty", "should_refuse", "refusal_type", "notes"]
OUT_OF_SCOPE = [
    "Hva koster en byggesøknad i kommunen, og hvor lenge tar behandlingen?", "Kan du fylle ut og sende søknaden for meg?",
    "Hvilke vedlegg vil kommunen ha, og hvordan skriver jeg et nabovarsel?", "Hvilke gebyrer gjelder for en dispensasjon?",
    "Hvordan vil en klagesak ende, og hvilken strategi bør jeg velge?", "Hvilke krav gjelder for ansvarsrett?",
    "Hvor nær nabogrensen kan jeg bygge i min kommune?", "Hvilken parkeringsnorm har byen?",
    "Kan du gi juridiske råd om byggfeil og reklamasjon?", "Hvordan søker jeg om ferdigattest?",
]
MISSING_CONTEXT = [
    "Kan du dimensjonere ventilasjonen for et kontorbygg på 350 m²?", "Kan du beregne U-verdier for huset mitt hvis jeg sender arealene?",
    "Hvilken brannklasse får bygget mitt?", "Er planløsningen min god nok, uten at du ser tegningene?",
    "Kan du lage en sjekkliste for akkurat mitt prosjekt?", "Hvor mye isolasjon trenger ytterveggen min?",
    "Kan den eksisterende trappen godkjennes uten måling?", "Hvilke produkter oppfyller kravene innenfor budsjettet mitt?",
]
WRAPPERS = ["Jeg har et praktisk spørsmål: ", "Kan du hjelpe meg med dette: ", "Jeg lurer på følgende: ", "Kort spørsmål: "]
#: Words in a topic, and questions about it; the first row that fits counts, the last fits always.
SCENARIOS: list[tuple[str, list[str]]] = [
    ("^krav ", ["Hvilke regler gjelder for {}?", "Hva betyr {} i praksis?", "Hva må jeg passe på ved {}?"]),
    ("trapp|repos|trinn", ["Jeg tegner en trapp. Hva kreves for {}?", "Hva er det minste som kreves for {}?"]),
    ("dør|porter|inngang", ["Hva gjelder for {} i et bygg?", "Finnes det bestemte krav til {}?"]),
    ("energikrav|energi|varme|kulde", ["Hva må dokumenteres om {}?", "Hva kreves av {} i nye bygg?"]),
    ("brann|brannsikkerhet", ["Hvilke regler gjelder for {}?", "Hva er det laveste nivået for {}?"]),
    ("", ["Hvilke regler gjelder for {}?", "Hva må jeg ta hensyn til ved {}?", "Hva sier forskriften om {}?"]),
]
TITLES = ["Hva sier {0} om {1}?", "Forklar kort hva {0} ({1}) handler om.", "Hva er hovedinnholdet i {0} – {1}?"]


def sections(provisions: DataFrame, order: str = "_ord") -> DataFrame:
    """(section_id, title, chapter, reg_text, guidance_text, _ord): the first provision of each section with id and title."""
    cols = [strip(text(F.col(c))).alias(c) for c in ("section_id", "title", "chapter", "reg_text", "guidance_text")]
    rows = provisions.select(*cols, F.col(order).alias("_ord")).filter("section_id <> '' AND title <> ''")
    return last_wins(rows, "section_id", keep="first")


def draw_key(key: Column, seed: int) -> Column:
    """A reproducible order: an MD5 of seed and key, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def topic(idx: Column) -> Column:
    """Two neighbouring keywords of the regulation, else of the guidance, else a phrasing of the title, by the item's number."""

    def pair(kw: Column) -> Column:
        n = F.size(kw)
        at = lambda i: F.element_at(kw, (i % n + 1).cast("int"))
        return F.when(n >= 2, F.concat(at(idx), F.lit(" "), at(idx + 1))).when(n == 1, at(idx))

    v = topic_variants(F.col("title"))
    return F.coalesce(pair(keywords(F.col("reg_text"))), pair(keywords(F.col("guidance_text"))), F.element_at(v, (idx % F.size(v) + 1).cast("int")))


def _fill(templates: list[str], idx: Column, *parts: Column) -> Column:
    out = F.element_at(F.array(*[F.lit(t) for t in templates]), (idx % len(templates) + 1).cast("int"))
    marks = ["{}"] if len(parts) == 1 else [f"{{{i}}}" for i in range(len(parts))]
    for mark, p in zip(marks, parts):
        out = F.replace(out, F.lit(mark), p)
    return out


def scenario(topic_column: Column, idx: Column) -> Column:
    low, out = F.lower(topic_column), None
    for pattern, templates in SCENARIOS:
        q = _fill(templates, idx, topic_column)
        out = F.when(low.rlike(pattern), q) if out is None else out.when(low.rlike(pattern), q)
    return out


def _item(ident: Column, kind: str, question: Column, targets: Column, hard: Column, refuse: bool, refusal: Column, notes: str) -> list[Column]:
    values = [ident, F.lit(kind), question, targets, hard, F.lit(refuse), refusal, F.lit(notes)]
    return [v.alias(n) for v, n in zip(values, ITEM)]


def single_items(drawn: DataFrame, style: str = "paraphrase") -> DataFrame:
    """One question per drawn section (with idx, from 1)."""
    idx = F.col("idx")
    q = _fill(TITLES, idx, F.col("section_id"), F.lower("title")) if style == "title" else scenario(topic(idx), idx)
    ident = F.format_string("auto_in_single_%03d", idx)
    return drawn.select(*_item(ident, "in_scope_single", q, F.array("section_id"), difficulty(F.col("section_id")), False, F.lit(None).cast("string"), f"made from sections ({style})"))


def multi_groups(sects: DataFrame, n: int, seed: int, most: int = 3) -> DataFrame:
    """(idx, members): n draws of two or three sections of one chapter, from chapters with at least two.

    Sections are ranked within their chapter by the draw's hash; only the first ``most`` of each draw and
    chapter are kept, so that a large chapter is never gathered.
    """
    most = min(3, max(2, most))
    chapter = F.when(F.col("chapter") == "", "(no_chapter)").otherwise(F.col("chapter"))
    rows = sects.withColumn("_ch", chapter)
    sizes = rows.groupBy("_ch").agg(F.count("*").alias("size")).filter("size >= 2")
    # Each chapter draws for each item; the chapter with the least hash takes it. Items are as many as were asked for.
    draws = sizes.withColumn("idx", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))))
    chosen = draws.groupBy("idx").agg(F.min_by(F.struct("_ch", "size"), F.md5(F.concat_ws(":", F.lit(str(seed)), "idx", "_ch"))).alias("c")).select("idx", "c.*")
    k = F.least("size", F.when(F.lit(most) > 2, F.lit(2) + (F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "idx")), 1, 1) >= "8").cast("int")).otherwise(F.lit(2)))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "idx", "section_id"))
    ranked = rows.join(chosen, "_ch").withColumn("_rn", F.row_number().over(W.partitionBy("idx").orderBy(order))).filter(F.col("_rn") <= k)
    return ranked.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("_rn", "section_id", "title", topic(F.col("idx") + F.col("_rn") - 1).alias("topic")))).alias("members"))


def multi_items(groups: DataFrame, style: str = "paraphrase") -> DataFrame:
    names = F.transform("members", lambda m: F.concat(m["section_id"], F.lit(" ("), m["title"], F.lit(")")) if style == "title" else m["topic"])
    q = F.concat(F.lit("Hvordan virker " if style == "title" else "Prosjektet mitt angår "), F.array_join(names, " og "), F.lit(" sammen, og hva må oppfylles i alt?" if style == "title" else ". Hva kreves samlet, og hva bør avklares først?"))
    return groups.select(*_item(F.format_string("auto_in_multi_%03d", F.col("idx")), "in_scope_multi", q, F.transform("members", lambda m: m["section_id"]), F.lit("hard"), False, F.lit(None).cast("string"), f"made from several sections ({style})"))


def refusal_items(spark: SparkSession, n: int, kind: str, style: str = "paraphrase") -> DataFrame:
    """Items that a system bound to the corpus should refuse."""
    idx = F.col("idx")
    q = _fill(MISSING_CONTEXT if kind == "in_domain_missing_context" else OUT_OF_SCOPE, idx)
    if style == "paraphrase":
        q = F.concat(_fill(WRAPPERS, idx), q)
    rows = spark.range(1, n + 1).withColumnRenamed("id", "idx")
    hard = F.when(idx % 3 == 0, "easy").otherwise("medium")
    return rows.select(*_item(F.format_string(f"auto_ref_{kind}_%03d", idx), "refusal", q, F.array().cast("array<string>"), hard, True, F.lit(kind), f"made to be refused ({style})"))


def question_set(provisions: DataFrame, n_in: int = 80, n_refuse: int = 40, seed: int = 17, multi_share: float = 0.0, multi_most: int = 3, in_domain_share: float = 0.5, style: str = "paraphrase") -> DataFrame:
    """A whole question set in a reproducible order; shares are clamped to [0, 1], counts rounded half to even."""
    share = lambda x: min(1.0, max(0.0, x))
    sects = sections(provisions)
    have = sects.count()
    n_in = min(max(0, n_in), have)
    n_multi = min(max(0, round(n_in * share(multi_share))), n_in)
    chapter = F.when(F.col("chapter") == "", "(no_chapter)").otherwise(F.col("chapter"))
    if n_multi and not sects.groupBy(chapter.alias("c")).count().filter("count > 1").limit(1).count():
        n_multi = 0
    drawn = sects.orderBy(draw_key(F.col("section_id"), seed), "section_id").limit(n_in - n_multi)
    drawn = drawn.withColumn("idx", F.row_number().over(W.orderBy(draw_key(F.col("section_id"), seed), "section_id")))  # at most n_in rows
    n_domain = min(max(0, round(max(0, n_refuse) * share(in_domain_share))), max(0, n_refuse))
    spark = provisions.sparkSession
    parts = [single_items(drawn, style), refusal_items(spark, max(0, n_refuse) - n_domain, "out_of_scope", style), refusal_items(spark, n_domain, "in_domain_missing_context", style)]
    if n_multi:
        parts.append(multi_items(multi_groups(sects, n_multi, seed, multi_most), style))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(draw_key(F.col("id"), seed))
