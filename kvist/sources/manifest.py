"""The log of downloaded snapshots: scan, selection, paths, and storing new snapshots."""

from __future__ import annotations

import datetime
import hashlib
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvist.schema import MANIFEST
from kvist.sources.records import append_line, read_jsonl

HEADERS = {"User-Agent": "kvist/0.1", "Accept": "text/html,application/xhtml+xml"}
TIMEOUT_S = 60


def with_defaults(manifest: DataFrame) -> DataFrame:
    """Missing final urls are the url, missing states 0, missing texts empty."""
    fill = {c: F.coalesce(c, F.lit("")) for c in ("url", "downloaded_at", "path", "sha256")}
    return manifest.withColumns(fill | {"final_url": F.coalesce("final_url", "url"), "status": F.coalesce("status", F.lit(0))})


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't JSON are skipped."""
    return with_defaults(read_jsonl(spark, path, MANIFEST, lenient=True))


def is_valid() -> Column:
    """Delivered, stored, and of HTML."""
    return (F.col("status") == 200) & (F.coalesce("path", F.lit("")) != "") & F.coalesce(F.contains(F.lower("content_type"), F.lit("text/html")), F.lit(False))


def latest_valid(manifest: DataFrame, *keys: str) -> DataFrame:
    """The last valid line (of each key, if keys are given); combined on the map side, no sort. Without keys no line raises."""
    names = [c for c in manifest.columns if c not in keys]
    valid = manifest.filter(is_valid())
    picked = (valid.groupBy(*keys) if keys else valid).agg(F.max_by(F.struct(*names), "_ord").alias("_r"))
    out = picked.select(*keys, "_r.*")
    if keys:
        return out
    return out.withColumn("_ord", F.when(F.col("_ord").isNull(), F.raise_error(F.lit("no valid snapshot"))).otherwise(F.col("_ord")))


def existing_snapshot(manifest: DataFrame, url: str, root: str) -> str | None:
    """The path of the last line of a url whose file exists; asked before a download."""
    for r in manifest.filter((F.col("url") == url) & (F.col("path") != "")).orderBy(F.desc("_ord")).toLocalIterator():
        path = resolve(r["path"], root)
        if os.path.exists(path):
            return path
    return None


def resolve(path: str, root: str) -> str:
    """A stored path on this machine."""
    if not path.startswith("/"):
        return os.path.join(root, path)
    parts = path.split("/")
    return path if os.path.exists(path) or "data" not in parts else os.path.join(root, *parts[parts.index("data") :])


def stored_path(path: str, root: str) -> str:
    """Relative to root where possible; empty if there is no file."""
    if not os.path.exists(path):
        return ""
    inside = os.path.relpath(path, root)
    return path if inside.startswith("..") else inside


def fetch(url: str) -> tuple[str, int, bytes, str | None]:
    """(final url, status, body, content type); network access, replaceable in ``download``."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS), timeout=TIMEOUT_S) as r:  # noqa: S310
            return r.url, r.status, r.read(), r.headers.get("Content-Type")
    except urllib.error.HTTPError as e:
        return e.url or url, e.code, b"", e.headers.get("Content-Type")


def download(spark: SparkSession, url: str, manifest_path: str, folder: str, root: str, force: bool = False, get: Callable = fetch, name: str = "snapshot.html") -> dict:
    """Store a snapshot under <folder>/<date>/ and append its line to the manifest; skipped where the url has a stored one.

    A body is stored only with status 200 and content; the same day's file is overwritten. The body is one
    page, so this runs on the driver. Returns the line.
    """
    if not force and os.path.exists(manifest_path) and (found := existing_snapshot(read_manifest(spark, manifest_path), url, root)):
        return {"url": url, "path": stored_path(found, root), "skipped": True}
    final, status, body, kind = get(url)
    now = datetime.datetime.now().replace(microsecond=0)
    path = os.path.join(folder, now.date().isoformat(), name)
    if status == 200 and body:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(body)
    stored = stored_path(path, root) if status == 200 and body else ""
    line = {"url": url, "final_url": final, "status": status, "downloaded_at": now.isoformat(), "path": stored, "sha256": hashlib.sha256(body).hexdigest() if body else "", "content_type": kind}
    append_line(spark, line, manifest_path)
    return line


def content_hash(content: Column) -> Column:
    """SHA-256 of a binary column; empty for empty or null content."""
    return F.when(F.length(content) > 0, F.sha2(content, 256)).otherwise(F.lit(""))
