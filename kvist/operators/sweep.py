"""Parameter sweeps: a grid of runs as rows, so that all runs are one job."""

from __future__ import annotations

import datetime
import itertools

from pyspark.sql import DataFrame, SparkSession

from kvist.operators.retrieval import normalize_method


def csv_list(value: str, kind: type = str) -> list:
    """Entries of a comma-separated list, stripped, empty ones dropped."""
    return [kind(x.strip()) for x in (value or "").split(",") if x.strip()]


def file_safe(name: str) -> str:
    return "".join("-" if c in "/\\: " else c for c in name)


def grid(repeat: int, prompts: list[str], top_ks: list[int], methods: list[str], alphas: list[float], temperatures: list[float], models: list[str] = ("",), stamp: str = "") -> list[dict]:
    """All runs; alphas vary only for hybrid retrieval, others take the first one. stamp: goes into each run's name."""
    out = []
    for r, p, k, m, model in itertools.product(range(repeat), prompts or ["baseline"], top_ks, [normalize_method(m) for m in methods], models):
        for a, t in itertools.product(alphas if m == "hybrid" else alphas[:1] or [0.5], temperatures):
            out.append({"run_idx": len(out) + 1, "repeat": r + 1, "prompt_version": p, "top_k": int(k), "retrieval_method": m, "hybrid_alpha": float(a), "temperature": float(t), "model": model})
    for x in out:
        x["run"] = run_name(x, stamp)
    return out


def time_stamp() -> str:
    """The present second, for names of runs that another sweep doesn't give again."""
    return datetime.datetime.now().strftime("%Y%m%d-%H%M%S")


def run_name(x: dict, stamp: str = "") -> str:
    return file_safe(f"{stamp}{'_' if stamp else ''}run{x['run_idx']:03d}_{x['model'] or 'model'}_{x['prompt_version']}_{x['retrieval_method']}_k{x['top_k']}_a{x['hybrid_alpha']:g}_t{x['temperature']:g}")


GRID = "run_idx int, repeat int, prompt_version string, top_k int, retrieval_method string, hybrid_alpha double, temperature double, model string, run string"


def grid_table(spark: SparkSession, runs: list[dict]) -> DataFrame:
    """The grid as a table; a few rows, made on the driver."""
    return spark.createDataFrame(runs, GRID)
