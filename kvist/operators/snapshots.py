"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kvist.functions.plain import plain_section_id

#: Snapshots of one key that one window holds; longer histories are cut into blocks with a halo.
BLOCK = 64


def number_deliveries(deliveries: DataFrame, entity: str, at: str, content: str | None = None) -> DataFrame:
    """Adds ``idx``, 1, 2, ... in the order of ``at`` within each entity; (entity, at) must be unique.

    content: a column; a delivery whose content is that of the one before is left out and isn't counted.
    Numbers in two levels, so that a hot entity isn't sorted in one task: rows are compared and counted by
    entity and day, the days' first and last contents are compared and their counts summed up (one small row
    per day), and each day is numbered alone.
    """
    rows = deliveries.withColumn("_day", F.to_date(F.col(at)))
    in_day, of_days = W.partitionBy(entity, "_day").orderBy(at), W.partitionBy(entity).orderBy("_day")
    first = F.row_number().over(in_day) == 1
    news = F.lit(True) if content is None else first | ~F.col(content).eqNullSafe(F.lag(content).over(in_day))
    rows = rows.withColumns({"_first": first, "_new": news})
    edges = [] if content is None else [F.min_by(F.struct(content), at).alias("_head"), F.max_by(F.struct(content), at).alias("_tail")]
    days = rows.groupBy(entity, "_day").agg(F.count_if("_new").alias("_n"), *edges)
    # A day's first delivery is none of the new ones where the day before ended with its content.
    same = F.lit(False) if content is None else F.coalesce(F.lag("_tail").over(of_days).eqNullSafe(F.col("_head")), F.lit(False))
    days = days.withColumn("_same", same)
    own = F.col("_n") - F.col("_same").cast("int")
    before = F.coalesce(F.sum(own).over(of_days.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = days.select(entity, "_day", "_same", before.alias("_before"))
    kept = rows.join(days, [entity, "_day"]).withColumn("_new", F.col("_new") & ~(F.col("_first") & F.col("_same"))).filter("_new")
    number = F.col("_before") + F.row_number().over(in_day)
    return kept.withColumn("idx", number.cast("long")).drop("_day", "_before", "_first", "_new", "_same")


def snapshot_changes(rows: DataFrame, entity: str, key: str, block: int = BLOCK) -> DataFrame:
    """Events between consecutive snapshots of an entity.

    rows: (entity, key, idx, fingerprint, label, next_label), one row per entity, key and snapshot that
    holds the key; idx counts the entity's snapshots without gaps, label names the snapshot, next_label
    the following one (null: there is none). Returns (entity, label, key, change); label is the later
    snapshot's. A lag of the fingerprint shows changes, a gap in idx a removal and a later addition.
    The first snapshot gives nothing. The window is cut into blocks of idx, with the neighbouring
    snapshot of each border in both blocks, so that no key with a long history makes one large group.
    """
    mine = F.floor(F.col("idx") / block)
    near = F.array_distinct(F.array(mine, F.floor((F.col("idx") + 1) / block), F.floor((F.col("idx") - 1) / block)))
    cut = rows.select("*", mine.alias("_own"), F.explode(near).alias("_block"))
    w = W.partitionBy(entity, key, "_block").orderBy("idx")
    seen = cut.select(
        entity, key, "idx", "fingerprint", "label", "next_label", (F.col("_own") == F.col("_block")).alias("_is_own"),
        F.lag("idx").over(w).alias("_before"), F.lag("fingerprint").over(w).alias("_was"), F.lead("idx").over(w).alias("_after"),
    ).filter("_is_own")
    follows = F.coalesce(F.col("_before") == F.col("idx") - 1, F.lit(False))
    stays = F.coalesce(F.col("_after") == F.col("idx") + 1, F.lit(False))

    def event(change: str, label: str, when: Column) -> Column:
        return F.when(when, F.struct(F.col(label).alias("label"), F.lit(change).alias("change")))

    events = F.array_compact(F.array(
        event("added", "label", ~follows & (F.col("idx") > 1)),
        event("changed", "label", follows & (F.col("_was") != F.col("fingerprint"))),
        event("removed", "next_label", ~stays & F.col("next_label").isNotNull()),
    ))
    return seen.select(entity, key, F.explode(events).alias("e")).select(entity, "e.label", key, "e.change")


def exact_fingerprint(*columns: Column) -> Column:
    """A SHA-256 over the columns' lengths and values; null differs from every text."""
    parts = [x for c in columns for x in (F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))]
    return F.sha2(F.concat(*parts), 256)


def section_changes(manifest: DataFrame, provisions: DataFrame) -> DataFrame:
    """(root_print_url, downloaded_at, section_id, change) between consecutive valid deliveries of each url.

    A delivery is a manifest line with status 200, a non-empty path and a content type with text/html in
    any case; of lines with one url and time the highest _ord holds; lines whose time can't be read, or
    without url, take no part. A delivery whose content isn't in provisions counts as an empty one.
    Rows without a section id are passed over; of rows with one plain section id in one content the
    highest _ord holds. Texts are compared as stored; null differs from text. Empty tables give no row.
    """
    at = F.expr("try_cast(trim(downloaded_at) AS timestamp_ntz)")
    valid = (F.col("status") == 200) & (F.trim("path") != "") & F.lower("content_type").contains("text/html")
    lines = manifest.filter(valid & F.col("url").isNotNull()).select("url", at.alias("at"), "downloaded_at", "sha256", "_ord").filter("at IS NOT NULL")
    single = lines.groupBy("url", "at").agg(F.max_by(F.struct("downloaded_at", "sha256"), "_ord").alias("d")).select("url", "at", "d.*")
    # Content delivered again and again counts once: only what differs from the delivery before goes on.
    numbered = number_deliveries(single, "url", "at", "sha256")
    following = numbered.select("url", (F.col("idx") - 1).alias("idx"), F.col("downloaded_at").alias("next_label"))
    deliveries = numbered.join(following, ["url", "idx"], "left").select("url", "sha256", "idx", F.col("downloaded_at").alias("label"), "next_label")

    content = (
        provisions.select(
            F.col("root_print_url").alias("url"), "sha256", plain_section_id(F.col("section_id")).alias("section_id"),
            exact_fingerprint(F.col("title"), F.col("reg_text"), F.col("guidance_text")).alias("fingerprint"), "_ord",
        )
        .filter("section_id IS NOT NULL")
        .groupBy("url", "sha256", "section_id").agg(F.max_by("fingerprint", "_ord").alias("fingerprint"))
    )
    rows = deliveries.join(content, ["url", "sha256"])
    return snapshot_changes(rows, "url", "section_id").select(
        F.col("url").alias("root_print_url"), F.col("label").alias("downloaded_at"), "section_id", "change"
    )
