"""Near-duplicates and similar vectors against brute force, with edges and hot groups."""

import random
from fractions import Fraction

import numpy as np
import pytest

from kvist.llm.neardup import SimilarityJoin, connected, near_duplicate_groups, near_duplicate_pairs, shingle_sets
from kvist.llm.similar import divisible_by_100, most_similar, similar_pairs

WORDS = [f"o{i}" for i in range(400)]


def variants(rng, n):
    """Texts in families that differ by few edits, and some that don't."""
    texts = []
    for _ in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.randint(20, 60))]
        for _ in range(rng.randint(1, 8)):
            t = base[:]
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 2)] = [rng.choice(WORDS)] * rng.randint(0, 2)
            texts.append(" ".join(t))
    return texts


def brute(texts, least=20, n=3, t="0.6"):
    t, sets = Fraction(t), {}
    for o, x in texts:
        w = (x or "").lower().split()
        if len(w) >= least:
            sets[o] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


@pytest.mark.parametrize("similarity", ["0.6", "0.8", "0.9"])
def test_pairs_against_brute_force(spark, similarity):
    rng = random.Random(7)
    texts = list(enumerate(variants(rng, 60), 1))
    texts += [(5001, texts[0][1]), (5002, texts[0][1].upper()), (5003, None), (5004, ""), (5005, "kort tekst"), (5006, texts[3][1] + " " + " ".join(rng.choice(WORDS) for _ in range(30000)))]
    df = spark.createDataFrame([(o, x, "clash") for o, x in texts], "_ord bigint, text string, id string").repartition(3)
    got = [tuple(r) for r in near_duplicate_pairs(df, similarity=similarity).collect()]
    want = brute(texts, t=similarity)
    assert len(got) == len(set(got)) and set(got) == want
    rows = {r["ord"]: r for r in near_duplicate_groups(df, similarity=similarity).collect()}
    assert {o: r["group_id"] for o, r in rows.items()} == components(rows, want)


def components(ids, pairs):
    label = {o: o for o in ids}
    for _ in range(60):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("block,band", [(4, 10_000), (4, 12), (64, 7)])
def test_one_sequence_in_every_record(spark, monkeypatch, block, band):
    """A list of all records is cut into blocks and bands; no task compares the whole list with itself, and nothing is lost."""
    import kvist.llm.neardup as neardup

    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BAND", band)
    rng = random.Random(3)
    texts = [(i, "felles ord her " + " ".join(rng.choice(WORDS) for _ in range(rng.randint(17, 19)))) for i in range(1, 120)]
    texts += [(1000 + i, " ".join(["a b c d e f g h i j k l m n o p q r s t u v w x y z"] + [f"q{i}"])) for i in range(40)]
    texts += [(2000 + i, texts[i][1] + f" ny{i}") for i in range(20)]
    df = spark.createDataFrame(texts, "_ord bigint, text string")
    for t in ("0.6", "0.9"):
        assert {tuple(r) for r in near_duplicate_pairs(df, similarity=t).collect()} == brute(texts, t=t)


def test_entries_of_a_long_list_meet_once():
    import numpy as np

    import kvist.llm.neardup as neardup

    n = 5 * neardup.BAND
    ident = np.arange(n)
    zeros, ones = np.zeros(n, np.int64), np.ones(n, np.int64)
    batch = neardup._entry_batch(ones * 7, ones * n, ident, zeros > 0, ones * 30, ones * 30, ones * 30, zeros, ones * 29, np.stack([zeros, zeros]))
    assert batch.num_rows == 5 * n
    x = neardup._read_entries(batch)
    _, sizes = np.unique(x["list"], return_counts=True)
    assert len(sizes) == 15 and sizes.max() < 2.2 * neardup.BAND
    cells = {}
    for a, c, s in zip(x["id"].tolist(), x["list"].tolist(), zip(x["crossed"].tolist(), x["side"].tolist())):
        if a < 300:
            cells.setdefault(c, []).append((a, *s))
    met = [tuple(sorted((p[0], q[0]))) for own in cells.values() for k, p in enumerate(own) for q in own[k + 1 :] if not p[1] or p[2] != q[2]]
    assert len(met) == len(set(met)) == 300 * 299 // 2


def test_groups_need_few_links(spark):
    """A thousand near copies of one text: links grow with the records, not with their pairs."""
    base = [f"w{i}" for i in range(100)]
    texts = [(i, " ".join([*base[: i % 90 + 5], f"x{i}", *base[i % 90 + 5 :]])) for i in range(1, 1001)]
    df = spark.createDataFrame(texts, "_ord bigint, text string")
    join = SimilarityJoin(shingle_sets(df, "_ord", "text"))
    assert join.answers(every=False).count() < 20_000
    rows = near_duplicate_groups(df).collect()
    assert len(rows) == 1000 and {r["group_id"] for r in rows} == {1} and 999 <= rows[0]["links"] < 20_000


def test_followers_are_used_and_exact(spark):
    """Long texts with one changed word: most sets follow a leader, and nothing is lost."""
    rng = random.Random(8)
    texts = []
    for f in range(6):
        base = [rng.choice(WORDS) for _ in range(120)]
        for v in range(12):
            t = base[:]
            t[rng.randrange(120)] = f"x{f}{v}"
            texts.append(" ".join(t))
    texts = list(enumerate(texts, 1))
    df = spark.createDataFrame(texts, "_ord bigint, text string")
    assert {tuple(r) for r in near_duplicate_pairs(df).collect()} == brute(texts)


def test_groups(spark):
    rng = random.Random(9)
    texts = list(enumerate(variants(rng, 25), 1)) + [(900 + i, "lik tekst " * 15) for i in range(200)]
    df = spark.createDataFrame(texts, "_ord bigint, text string")
    pairs, rows = brute(texts), {r["ord"]: r for r in near_duplicate_groups(df).collect()}
    assert len(rows) == sum(len(x.split()) >= 20 for _, x in texts)
    label = {o: o for o in rows}
    for _ in range(30):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {o: r["group_id"] for o, r in rows.items()} == label
    assert near_duplicate_groups(df.limit(0)).count() == 0 == near_duplicate_pairs(df.limit(0)).count()


def test_components_of_a_long_path(spark):
    path = spark.range(1, 60).selectExpr("id AS a", "id + 1 AS b")
    assert {r["component"] for r in connected(path).collect()} == {1}


def test_bad_similarity(spark):
    with pytest.raises(ValueError):
        SimilarityJoin(spark.createDataFrame([], "ord bigint, n int, items array<bigint>"), "0")


def vectors(n, seed=3, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = [base[k] + rng.normal(size=dim) * 0.25 for k in rng.integers(0, n, n // 2)]
    return [list(map(float, v * rng.uniform(0.3, 3))) for v in (*base, *near)]


def exact(rows, k=5, floor=0.9):
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows], np.float32)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :k]
    return {ids[i]: [ids[j] for j in top[i]] for i in range(len(ids))}, {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in top[i] if s[i, j] >= floor}


def test_similar_vectors_against_brute_force(spark):
    rows = [(f"{i:05d}", v) for i, v in enumerate(vectors(1500))]
    top, pairs = exact(rows)
    extra = [("n", None), ("z", [0.0] * 64), ("s", [1.0, 2.0]), ("e", []), ("x", [float("nan")] * 64), (None, rows[0][1]), ("h", [None] * 64)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + extra], "id string, embedding array<double>, no string")
    got = {tuple(r) for r in similar_pairs(df, "id", "embedding").collect()}
    assert len(got & pairs) >= 0.97 * len(pairs) and len(got - pairs) <= 0.03 * len(pairs)
    near = most_similar(df, "id", "embedding", probes=0.5).collect()
    hits = sum(r["neighbour"] in top[r["id"]] for r in near)
    assert len({(r["id"], r["rank"]) for r in near}) == len(near) == 5 * len(rows) and hits >= 0.9 * 5 * len(rows)


def test_recall_of_all_five_at_the_default_lists(spark):
    """The collection itself, every row a query: at least 0.95 of the five nearest, whatever their cosine."""
    df = spark.read.parquet("/root/testdata/sf0.01/chroma_collection.parquet")
    rows = [(r["id"], r["embedding"]) for r in df.select("id", "embedding").collect() if r["embedding"] and any(r["embedding"])]
    v = np.array([x for _, x in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    least = dict(zip([i for i, _ in rows], np.sort(s, axis=1)[:, -5]))
    near = most_similar(df, "id", "embedding").collect()
    assert len(near) == 5 * len(rows) and sum(r["cosine"] >= least[r["id"]] - 1e-5 for r in near) >= 0.95 * len(near)


def test_hot_copies_and_small_tables(spark):
    rows = [(f"c{i:04d}", [1.0, 2.0, 3.0, 4.0]) for i in range(900)] + [(f"d{i}", [1.0, 2.0, 3.0, 4.0 + i]) for i in range(1, 4)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = [(r["id"], r["neighbour"], r["rank"]) for r in most_similar(df, "id", "embedding").collect()]
    assert len(got) == 5 * len(rows)
    assert [n for i, n, _ in sorted(got) if i == "c0003"] == ["c0000", "c0001", "c0002", "c0004", "c0005"]
    assert [n for i, n, _ in sorted(got) if i == "d1"] == ["c0000", "c0001", "c0002", "c0003", "d2"]
    assert most_similar(df.limit(0), "id", "embedding").count() == 0 and most_similar(df.limit(1), "id", "embedding").count() == 0


def test_divisible_by_100(spark):
    ids = [f"{n:024x}" for n in (0, 100, 12345600, 2**95 - 2**95 % 100, 1, 99, 2**95)]
    got = {r["id"] for r in spark.createDataFrame([(i,) for i in ids], "id string").filter(divisible_by_100(__import__("pyspark.sql.functions").sql.functions.col("id"))).collect()}
    assert got == {i for i in ids if int(i, 16) % 100 == 0}


def test_heavy_lists_meet_in_a_grid(spark, monkeypatch):
    import kvist.llm.similar as similar

    monkeypatch.setattr(similar, "PART_ROWS", 40)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(f"{i:04d}", list(map(float, centre + rng.normal(size=16) * 0.05))) for i in range(500)] + [(f"{i:04d}", list(map(float, rng.normal(size=16)))) for i in range(500, 700)]
    top, _ = exact(rows)
    got = most_similar(spark.createDataFrame(rows, "id string, embedding array<float>"), "id", "embedding", probes=1.0 - 1e-9).collect()
    assert len({(r["id"], r["neighbour"]) for r in got}) == len(got) == 5 * len(rows)
    assert sum(r["neighbour"] in top[r["id"]] for r in got) >= 0.97 * len(got)


@pytest.mark.parametrize("query_rows", [65_536, 500])
def test_a_third_in_one_near_group(spark, monkeypatch, query_rows):
    import kvist.llm.similar as similar

    monkeypatch.setattr(similar, "QUERY_ROWS", query_rows)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[:2000] = v[0] + rng.normal(size=(2000, 64)) * ((1 / 0.93 - 1) / 64) ** 0.5
    rows = [(f"{i:05d}", list(map(float, x))) for i, x in enumerate(v)]
    top, pairs = exact(rows)
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    assert {tuple(r) for r in similar_pairs(df, "id", "embedding").collect()} == pairs
    if query_rows == 500:
        near = most_similar(df, "id", "embedding", probes=10**6).collect()
        assert len(near) == 5 * len(rows) and all(r["neighbour"] in top[r["id"]] for r in near)


@pytest.mark.parametrize("some", [False, True])
def test_no_query_travels_under_a_floor(spark, monkeypatch, some):
    """Portions of the index meet scans of all rows: pairs within and across portions, salted lists, and no shuffle in a scan's plan."""
    import kvist.llm.similar as similar

    plans = []
    write = similar.materialize

    def noted(df, **kinds):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, **kinds)

    monkeypatch.setattr(similar, "HELD_FLOATS", 64 * 300)
    monkeypatch.setattr(similar, "materialize", noted)
    v = np.array(vectors(800))
    v[:500] = v[0] / np.linalg.norm(v[0]) + np.random.default_rng(4).normal(size=(500, 64)) * 0.02
    ids = [f"{i:05d}" for i in range(len(v))]
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in zip(ids, v)], "id string, embedding array<float>").repartition(5)
    unit = v.astype(np.float32) / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    fifth = np.maximum(np.sort(s, axis=1)[:, -5:-4], 0.9)
    sure, may = ({(ids[i], ids[j]) for i, j in zip(*np.nonzero(s >= fifth + e))} for e in (1e-6, -1e-6))  # beyond rounding
    if some:
        got = {(r["id"], r["neighbour"]) for r in most_similar(df, "id", "embedding", floor=0.9, asks=similar.F.col("id").cast("int") % 10 == 0).collect()}
        sure, may = ({(a, b) for a, b in x if int(a) % 10 == 0} for x in (sure, may))
    else:
        got = {tuple(r) for r in similar_pairs(df, "id", "embedding").collect()}
        sure, may = ({(min(p), max(p)) for p in x} for x in (sure, may))
    assert sure and sure <= got <= may
    scans = [p for p in plans if "MapInArrow" in p and "cosine" in p]
    assert len(scans) >= 4 and not any("FlatMapGroupsInArrow" in p for p in plans)
    assert all("REPARTITION" in p or "Exchange" not in p for p in scans)
