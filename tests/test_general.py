"""Snapshot changes and copy comparison against brute force, with edge cases and hot keys."""

import datetime
import random

from pyspark.sql import functions as F

from kvist.functions.plain import plain_section_id
from kvist.operators.copies import compare_copies, compare_run_logs
from kvist.operators.snapshots import number_deliveries, section_changes, snapshot_changes

MANIFEST = "_ord bigint, url string, final_url string, status int, downloaded_at string, path string, sha256 string, content_type string, section_id string"
PROVISIONS = "_ord bigint, root_print_url string, sha256 string, section_id string, title string, reg_text string, guidance_text string, url string, idx int"


def line(o, url, at, sha, status=200, path="p", kind="text/html"):
    return (o, url, None, status, at, path, sha, kind, "clash")


def section(o, url, sha, sid, title="t", reg="r", guide=None):
    return (o, url, sha, sid, title, reg, guide, "clash", 1)


def changes(spark, manifest, provisions):
    df = section_changes(spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(provisions, PROVISIONS))
    assert df.columns == ["root_print_url", "downloaded_at", "section_id", "change"]
    return sorted(tuple(r) for r in df.collect())


def test_added_removed_changed_and_gap(spark):
    m = [line(5, "u", "2022-01-01T00:00:00", "a"), line(1, "u", "2022-01-02 00:00:00", "b"), line(2, "u", "2022-01-03T00:00:00", "c"), line(3, "u", "2022-01-04T00:00:00", "a")]
    p = [
        section(1, "u", "a", "§ 1-1"), section(2, "u", "a", "1-2"), section(3, "u", "b", "§ 1–2"), section(4, "u", "b", "§ 1-3"), section(5, "u", "c", "§ 1-2", title=None),
        section(6, "u", "b", None), section(7, "u", "c", "§ 1-3", reg="old"), section(8, "u", "c", "§ 1-3"), section(9, "v", "a", "§ 9-9"),
    ]
    assert changes(spark, m, p) == [
        ("u", "2022-01-02 00:00:00", "§ 1-1", "removed"), ("u", "2022-01-02 00:00:00", "§ 1-3", "added"), ("u", "2022-01-03T00:00:00", "§ 1-2", "changed"),
        ("u", "2022-01-04T00:00:00", "§ 1-1", "added"), ("u", "2022-01-04T00:00:00", "§ 1-2", "changed"), ("u", "2022-01-04T00:00:00", "§ 1-3", "removed"),
    ]


def test_useless_lines_and_ties(spark):
    m = [
        line(1, "u", "2022-01-01T00:00:00", "a"), line(2, "u", "2022-01-02T00:00:00", "b", status=404), line(3, "u", "2022-01-02T01:00:00", "b", path=""), line(4, "u", "2022-01-02T02:00:00", "b", path=None),
        line(5, "u", "2022-01-02T03:00:00", "b", kind=None), line(6, "u", "2022-01-02T04:00:00", "b", kind="application/pdf"), line(7, "u", "soon", "b"), line(8, "u", None, "b"), line(9, None, "2022-01-02T05:00:00", "b"),
        line(11, "u", "2022-01-03T00:00:00", "b", kind="TEXT/HTML; charset=utf-8"), line(10, "u", "2022-01-03T00:00:00", "a"), line(12, "u", "2022-01-04T00:00:00", "missing"), line(13, "u", "2022-01-05T00:00:00", None),
    ]
    p = [section(1, "u", "a", "§ 1-1"), section(2, "u", "b", "§ 1-1", guide="x")]
    assert changes(spark, m, p) == [("u", "2022-01-03T00:00:00", "§ 1-1", "changed"), ("u", "2022-01-04T00:00:00", "§ 1-1", "removed")]


def test_empty_tables(spark):
    assert changes(spark, [], []) == [] and changes(spark, [line(1, "u", "2022-01-01T00:00:00", "a")], []) == []


def test_blocks_against_brute_force(spark):
    rng = random.Random(3)
    rows, want = [], []
    for url in ("hot", "cold"):
        n = 40 if url == "hot" else 5
        state = [{k: rng.randint(0, 2) for k in "abcdef" if rng.random() < 0.6} for _ in range(n)]
        for i, s in enumerate(state, 1):
            rows += [(url, k, i, str(v), str(i), str(i + 1) if i < n else None) for k, v in s.items()]
            if i > 1:
                old = state[i - 2]
                want += [(url, str(i), k, "added") for k in s if k not in old] + [(url, str(i), k, "removed") for k in old if k not in s]
                want += [(url, str(i), k, "changed") for k in s if k in old and s[k] != old[k]]
    df = spark.createDataFrame(rows, "u string, k string, idx bigint, fingerprint string, label string, next_label string")
    for block in (1, 2, 7, 64):
        assert sorted(tuple(r) for r in snapshot_changes(df, "u", "k", block).collect()) == sorted(want)


def test_numbering_in_two_levels(spark):
    start = datetime.datetime(2022, 1, 1)
    times = [("u", start + datetime.timedelta(hours=5 * i)) for i in range(30)] + [("v", start)]
    random.Random(1).shuffle(times)
    df = spark.createDataFrame(times, "url string, at timestamp_ntz")
    got = {(r["url"], r["at"]): r["idx"] for r in number_deliveries(df, "url", "at").collect()}
    assert [got["u", start + datetime.timedelta(hours=5 * i)] for i in range(30)] == list(range(1, 31)) and got["v", start] == 1


def test_numbering_leaves_out_repeated_contents(spark):
    rng = random.Random(5)
    start, rows, want = datetime.datetime(2022, 1, 1), [], {}
    for url in "uvw":
        was, n = "no content yet", 0
        for i in range(60):
            at, sha = start + datetime.timedelta(hours=7 * i), rng.choice(["a", "b", None, None if url == "w" else "a"])
            rows.append((url, at, sha))
            if sha != was:
                was, n = sha, n + 1
                want[url, at] = n
    random.Random(2).shuffle(rows)
    got = number_deliveries(spark.createDataFrame(rows, "url string, at timestamp_ntz, sha256 string"), "url", "at", "sha256")
    assert {(r["url"], r["at"]): r["idx"] for r in got.collect()} == want


def test_plain_section_ids(spark):
    cases = {"§ 8-5": "§ 8-5", "8-5": "§ 8-5", "§​ ８–５а ": "§ 8-5a", "": None, "​": None, "kapittel  x": "kapittel x", "§": "§"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "a string, b string")
    assert [r for r in df.select(plain_section_id(F.col("a")).alias("x"), "b").collect() if r["x"] != r["b"]] == []


LOG = "_ord bigint, id string, model_refused boolean, any_hit boolean, retrieval_hit boolean, full_hit boolean, question string"


def test_copies(spark):
    a = [(1, " x\t", True, True, None, None, ""), (2, "x", False, True, None, None, ""), (3, "y", None, None, True, True, ""), (4, None, True, True, True, True, ""), (5, " ", True, True, True, True, ""), (6, "only_a", None, None, None, None, "")]
    b = [(9, "x", False, False, None, False, "other"), (1, "y", None, True, None, True, ""), (2, "only_b", True, True, True, True, "")]
    df = compare_run_logs(spark.createDataFrame(a, LOG), spark.createDataFrame(b, LOG))
    assert sorted(tuple(r) for r in df.collect()) == [("only_a", "missing_in_b"), ("only_b", "missing_in_a"), ("x", "any_hit"), ("x", "full_hit")]


def test_copies_empty_hot_and_extra_columns(spark):
    none = spark.createDataFrame([], LOG)
    assert compare_run_logs(none, none).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("_ord"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 7).alias("v"), F.lit(1).alias("_side"))
    got = compare_copies(hot, hot.withColumn("v", F.col("v") + F.when(F.col("_ord") == 2997, 1).otherwise(0)), F.col("k"), {"v": F.col("v")}, name="k")
    assert [tuple(r) for r in got.collect()] == [("hot", "v")]
