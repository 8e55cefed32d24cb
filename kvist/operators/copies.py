"""Differences between two copies of one dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_copies(a: DataFrame, b: DataFrame, key: Column, fields: dict[str, Column], order: str = "_ord", name: str = "id") -> DataFrame:
    """(name, diff): keys that only one copy has, and fields that differ, one row each.

    Sides are tagged and united, grouped once by key (map-side combined, so a hot key costs nothing),
    one struct of fields is kept per side, that of the highest ``order``; the structs are compared by
    a generated higher-order expression. diff is missing_in_a, missing_in_b or the field's name. Null
    and empty keys are ignored; null equals null only. Rows with null ``order`` lose to all others.
    Empty copies: all keys of the other one are missing. Other columns play no part.
    """
    values = F.struct(*[c.alias(n) for n, c in fields.items()])

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(key.alias("_key"), F.lit(tag).alias("_side"), F.coalesce(F.col(order), F.lit(-(2**63))).alias("_at"), values.alias("_v"))

    both = side(a, "a").unionByName(side(b, "b")).filter("_key <> ''")
    pick = lambda tag: F.max_by(F.when(F.col("_side") == tag, F.col("_v")), F.when(F.col("_side") == tag, F.col("_at")))
    has = lambda tag: F.max(F.col("_side") == tag)
    grouped = both.groupBy("_key").agg(has("a").alias("_in_a"), has("b").alias("_in_b"), pick("a").alias("_a"), pick("b").alias("_b"))
    differs = F.filter(
        F.array(*[F.struct(F.lit(n).alias("n"), (~F.col(f"_a.{n}").eqNullSafe(F.col(f"_b.{n}"))).alias("d")) for n in fields]),
        lambda x: x["d"],
    )
    diffs = (
        F.when(~F.col("_in_a"), F.array(F.lit("missing_in_a")))
        .when(~F.col("_in_b"), F.array(F.lit("missing_in_b")))
        .otherwise(F.transform(differs, lambda x: x["n"]))
    )
    return grouped.select(F.col("_key").alias(name), F.explode(diffs).alias("diff"))


def compare_run_logs(a: DataFrame, b: DataFrame) -> DataFrame:
    """compare_copies of two run logs by id without surrounding blanks and tabs; any_hit falls back on retrieval_hit."""
    key = F.regexp_replace(F.col("id"), r"^[ \t]+|[ \t]+$", "")
    fields = {"model_refused": F.col("model_refused"), "any_hit": F.coalesce("any_hit", "retrieval_hit"), "full_hit": F.col("full_hit")}
    return compare_copies(a, b, key, fields)
