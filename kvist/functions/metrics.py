"""Metrics of a confusion matrix (refusal is the positive class), as Columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvist.functions.text import safe_div

#: The normal quantile of the interval.
Z = 1.96


def confusion(should_refuse: Column, model_refused: Column, within: Column | None = None) -> dict[str, Column]:
    """Counts tp, fp, tn, fn; null counts as false, ``within`` restricts the rows."""
    s, m = F.coalesce(should_refuse, F.lit(False)), F.coalesce(model_refused, F.lit(False))
    w = F.coalesce(within, F.lit(False)) if within is not None else F.lit(True)
    return {"tp": F.count_if(w & s & m), "fp": F.count_if(w & ~s & m), "tn": F.count_if(w & ~s & ~m), "fn": F.count_if(w & s & ~m)}


def refusal_metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Nine metrics; 0 on empty denominators."""
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    total = tp + fp + tn + fn
    precision, recall, specificity = safe_div(tp, tp + fp), safe_div(tp, tp + fn), safe_div(tn, tn + fp)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return {
        "accuracy": safe_div(tp + tn, total), "precision": precision, "recall": recall, "specificity": specificity,
        "f1": safe_div(2.0 * precision * recall, precision + recall), "balanced_accuracy": 0.5 * (recall + specificity),
        "mcc": safe_div(tp * tn - fp * fn, F.sqrt(product)), "refusal_rate_pred": safe_div(tp + fp, total), "refusal_rate_true": safe_div(tp + fn, total),
    }


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The score interval of a share; (0, 0) without trials, clamped to [0, 1]."""
    n = n.cast("double")
    p = safe_div(successes, n)
    scale = 1 + safe_div(F.lit(z * z), n)
    centre = (p + safe_div(F.lit(z * z), 2 * n)) / scale
    half = z / scale * F.sqrt(safe_div(p * (1 - p), n) + safe_div(F.lit(z * z), 4 * n * n))
    none = n <= 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), centre + half))
