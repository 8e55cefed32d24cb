"""The most similar vectors of every vector, by an inverted file with product-quantised residuals.

Unit vectors are assigned to the lists of coarse centroids; what remains is quantised per subspace. A
query without a floor probes its nearest lists: one table per query holds the products of its subvectors
with all code words, so that a candidate's approximate cosine is the centroid's plus one look-up per
subspace (asymmetric distances). What the quantiser's own error at a vector doesn't exclude is ranked by
its exact cosine. Lists that lie near each other form parts, so that a query travels once per part and not
once per list. Under a floor a query looks into every list that may hold a vector near enough, and there at
every vector whose angle to the centroid allows it; nothing above the floor is missed. That is a large share of all lists,
so that queries don't travel: the lists are held in portions, one after the other, and each portion meets a scan of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kvist.session import materialize, spread, union_all

#: Vectors that the index is fitted on at most, drawn by the hash of their number; every vector is indexed.
SAMPLE = 40_000
#: Lists per square root of the number of vectors, and at most.
LISTS, MOST_LISTS = 2.0, 4096
#: Subspaces and code words of the residuals.
SUBSPACES, CODES = 8, 256
#: Index rows of a part; a list with more is cut into salted parts. Queries that meet a part in one group.
PART_ROWS, QUERY_ROWS = 8192, 32_768
#: Floats of index vectors that a worker holds in one scan under a floor.
HELD_FLOATS = 16_000_000
#: Queries that are compared with a list at once, and what rounding may change a cosine or an angle by.
TOGETHER, ROUNDING = 512, 1e-3
#: Lists that a query looks into; their share of all lists falls with the number of vectors.
PROBES = 24
K = 5
FOUND = "q bigint, x bigint, cosine float"


@dataclass
class Index:
    """Centroids (lists x dim), code words (subspaces x codes x dim / subspaces), each list's part and its salts; blocks of queries by part."""

    centroids: np.ndarray
    codes: np.ndarray
    part: np.ndarray
    salts: np.ndarray
    blocks: np.ndarray | None = None

    @staticmethod
    def fit(sample: np.ndarray, total: int, seed: int = 17) -> Index:
        """Fit on a sample (rows of unit length) of ``total`` vectors; parts of PART_ROWS rows."""
        most = PART_ROWS
        rng = np.random.default_rng(seed)
        lists = int(max(1, min(MOST_LISTS, LISTS * math.sqrt(total), len(sample) / 4)))
        centroids = _means(sample, lists, rng, 8, unit=True)
        home = _nearest(sample, centroids)
        rest = sample - centroids[home]
        cut = SUBSPACES if sample.shape[1] % SUBSPACES == 0 else 1
        width = sample.shape[1] // cut
        few = rest[rng.permutation(len(rest))[: 64 * CODES]]
        codes = [_means(few[:, s * width : (s + 1) * width], min(CODES, len(few)), rng, 6) for s in range(cut)]
        weight = np.bincount(home, minlength=lists) * (total / max(1, len(sample)))
        part, salts = np.zeros(lists, np.int32), np.ones(lists, np.int32)
        heavy = np.flatnonzero(weight > most)
        for k, h in enumerate(heavy):
            part[h], salts[h] = k, math.ceil(weight[h] / most)
        todo, after = [np.flatnonzero(weight <= most)], len(heavy)
        while todo:
            own = todo.pop()
            if len(own) > 1 and weight[own].sum() > most:
                c = centroids[own] - centroids[own].mean(0)
                along = c @ np.linalg.svd(c, full_matrices=False)[2][0]
                order = np.argsort(along, kind="stable")
                half = int(np.searchsorted(np.cumsum(weight[own][order]), weight[own].sum() / 2))
                half = min(max(half, 1), len(own) - 1)
                todo += [own[order[:half]], own[order[half:]]]
            else:
                part[own] = after
                after += 1
        return Index(centroids, np.stack(codes).astype(np.float32), part, salts)

    def reach(self, x: np.ndarray, probes: float) -> tuple[np.ndarray, np.ndarray]:
        """(home, rows x lists): each row's list, and the lists that it looks into as a query without a floor."""
        score = x @ self.centroids.T
        p = max(1, min(len(self.centroids), int(probes if probes >= 1 else math.ceil(probes * len(self.centroids)))))
        near = np.zeros(score.shape, bool)
        np.put_along_axis(near, np.argpartition(-score, p - 1, axis=1)[:, :p], True, 1)
        return np.argmax(score, 1).astype(np.int32), near

    def within(self, x: np.ndarray, home: np.ndarray, lists: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows x lists, cosine of each row and centroid): may one of these lists hold a vector within the floor's angle of a row?

        A vector y of another list h is nearer to that centroid than to home's, so it lies beyond the plane
        between the two; y can't be within the floor's angle of x where x is farther than its sine from the plane.
        """
        score = x @ self.centroids[lists].T
        if floor <= 0:
            return np.ones(score.shape, bool), score
        square = (self.centroids**2).sum(1)
        apart = np.sqrt(np.maximum(square[:, None] + square[lists] - 2 * (self.centroids @ self.centroids[lists].T), 0))[home]
        deep = np.einsum("ij,ij->i", x, self.centroids[home])[:, None] - score
        return deep <= apart * math.sqrt(1 - floor * floor) + ROUNDING, score

    def lists_of(self) -> list[np.ndarray]:
        """The lists of each part, in their order."""
        order = np.argsort(self.part, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.part[order])) + 1)

    def plan(self, sample: np.ndarray, asking: int, probes: float) -> Index:
        """Set the blocks that the queries of each part are cut into, by how many of a sample reach it."""
        near = self.reach(sample[:2000], probes)[1]
        share = np.array([near[:, own].any(1).mean() for own in self.lists_of()])
        salts = np.array([self.salts[own[0]] for own in self.lists_of()])
        self.blocks = np.maximum(np.ceil(asking * share / QUERY_ROWS), salts).astype(np.int64)
        return self

    def encode(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        cut, _, width = self.codes.shape
        rest = x - self.centroids[home]
        return np.stack([_nearest(rest[:, s * width : (s + 1) * width], self.codes[s]) for s in range(cut)], 1).astype(np.uint8)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - half, 1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int, unit: bool = False) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].astype(np.float32)
    for _ in range(rounds):
        home = _nearest(x, centres)
        order = np.argsort(home, kind="stable")
        found, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centres[found] = sums / np.diff(np.append(first, len(x)))[:, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def usable_vectors(df: DataFrame, ident: str, vector: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """((id, no, v, k1, k2), dim): rows with an id and a finite vector that isn't zero, of the most frequent length (or dim)."""
    rows = df.select(F.col(ident).alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    if dim is None:
        top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = top["d"] if top else 0
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(3e38)))
    good = rows.filter((F.size("v") == max(dim, 1)) & finite & F.exists("v", lambda x: x != 0))
    return materialize(good.select("id", F.monotonically_increasing_id().alias("no"), "v", F.xxhash64("v").alias("k1"), F.hash("v").alias("k2"))), dim


def _sample(reps: DataFrame, total: int, dim: int) -> np.ndarray:
    share = min(1.0, SAMPLE / max(1, total))
    picked = reps.filter(F.pmod(F.xxhash64("no", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow()
    flat = [_matrix(c, dim) for c in picked.column(0).chunks if len(c)]
    return _unit(np.concatenate(flat)) if flat else np.zeros((0, dim), np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _route(reps: DataFrame, index, dim: int, probes: float) -> DataFrame:
    """(part, no, home, code, lists, x): index rows and the queries that each part must answer; lists has a bit for each list of the part.

    The index rows of a part meet its queries in a grid of salts by blocks. Where a part has one salt, a row
    of it that is a query too travels as one for both to its own block.
    """

    def run(batches):
        ix: Index = index.value
        lists_of = ix.lists_of()
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                no, x = some.column(0).to_numpy(), _unit(_matrix(some.column(1), dim))
                home, near = ix.reach(x, probes)
                near &= some.column(2).to_numpy(zero_copy_only=False).astype(bool)[:, None]
                codes, own = ix.encode(x, home), ix.part[home]

                def rows(k, key, at_home, bits):
                    home_or_none = np.where(at_home, home[k], -1).astype(np.int32)
                    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(no[k]), pa.array(home_or_none), _binary(codes[k]), _binary(bits), _binary(x[k])], names=["part", "no", "home", "code", "lists", "x"])

                for p, lists in enumerate(lists_of):
                    asked, salts, blocks = near[:, lists], int(ix.salts[lists[0]]), int(ix.blocks[p])
                    bits = np.packbits(asked, axis=1)
                    asked, held = asked.any(1), own == p
                    if salts == 1:
                        for b in range(blocks):
                            mine = asked & (no % blocks == b)
                            k = np.flatnonzero(held | mine)
                            if len(k):
                                yield rows(k, np.full(len(k), (p << 40) + b, np.int64), held[k], np.where(mine[k, None], bits[k], 0).astype(np.uint8))
                        continue
                    k = np.flatnonzero(held)
                    if len(k):
                        for b in range(blocks):
                            yield rows(k, (p << 40) + (no[k] % salts << 20) + b, held[k], np.zeros_like(bits[k]))
                    k = np.flatnonzero(asked)
                    if len(k):
                        for c in range(salts):
                            yield rows(k, (p << 40) + (c << 20) + no[k] // salts % blocks, np.zeros(len(k), bool), bits[k])

    return reps.select("no", "v", "asks").mapInArrow(run, "part bigint, no bigint, home int, code binary, lists binary, x binary")


def _search(routed: DataFrame, index, k: int) -> DataFrame:
    """(q, x, cosine): the k best candidates of each query within each part."""

    def run(t: pa.Table) -> pa.Table:
        ix: Index = index.value
        cut, _, width = ix.codes.shape
        t = t.combine_chunks()
        no, home = t.column("no").to_numpy(), t.column("home").to_numpy()
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(len(no), -1)
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(no), cut)
        lists = ix.lists_of()[t.column("part")[0].as_py() >> 40]
        bits = np.frombuffer(b"".join(t.column("lists").to_pylist()), np.uint8).reshape(len(no), -1)
        own, asking = np.flatnonzero(home >= 0), np.flatnonzero(bits.any(1))
        own = own[np.argsort(home[own], kind="stable")]
        low, high = (np.searchsorted(home[own], lists, s) for s in ("left", "right"))
        held, held_no, held_code = x[own], no[own], code[own]
        # The quantiser's error of a row bounds how far its approximate cosine is off.
        coded = np.concatenate([ix.codes[s][held_code[:, s]] for s in range(cut)], 1)
        error = np.linalg.norm(held - ix.centroids[home[own]] - coded, axis=1) + ROUNDING
        best = _Best(len(asking), k)

        def exact(w: np.ndarray, first: int, last: int, tables: list[np.ndarray]) -> None:
            """Rank rows first to last for the queries w, without those that can't come among the best."""
            least = best.cosine[w, -1]
            use = slice(first, last)
            if np.isfinite(least).all():
                bound = (x[asking[w]] @ ix.centroids[home[own[first]]])[:, None] + error[use]
                for s in range(cut):
                    bound += tables[s][:, held_code[use, s]]
                at_q, at_x = np.nonzero(bound >= least[:, None])
                value = np.einsum("ij,ij->i", x[asking[w[at_q]]], held[use][at_x])
            else:
                score = x[asking[w]] @ held[use].T
                at_q, at_x = np.nonzero(score >= least[:, None])
                value = score[at_q, at_x]
            row = held_no[use][at_x]
            other = row != no[asking[w[at_q]]]
            best.add(w[at_q[other]], value[other], row[other])

        for a in range(0, len(asking), 8192):
            some = asking[a : a + 8192]
            asked = np.unpackbits(bits[some], axis=1)[:, : len(lists)].astype(bool)
            tables = [x[some, s * width : (s + 1) * width] @ ix.codes[s].T for s in range(cut)]
            for j in np.argsort(-asked.sum(0), kind="stable"):
                if low[j] == high[j]:
                    continue
                w = a + np.flatnonzero(asked[:, j])
                for b in range(0, len(w), TOGETHER):
                    q = w[b : b + TOGETHER]
                    for c in range(low[j], high[j], PART_ROWS):
                        exact(q, c, min(high[j], c + PART_ROWS), [m[q - a] for m in tables])
        return pa.Table.from_batches([best.rows(no[asking])])

    return routed.groupBy("part").applyInArrow(run, FOUND)


def _portions(rows: DataFrame, most: int) -> list[Column]:
    """Conditions that cut the index rows (no, home) into portions of about ``most`` rows: lists in their order; a longer list is salted."""
    counts = [(r["home"], r["count"]) for r in rows.groupBy("home").count().orderBy("home").collect()]  # a row per list
    out, first, held = [], None, 0
    for h, n in [*counts, (None, 0)]:
        if first is not None and (h is None or held + n > most):
            salts = -(-held // most)
            out += [F.col("home").between(first, last) & (F.pmod(F.xxhash64("no", F.lit(7)), F.lit(salts)) == s) if salts > 1 else F.col("home").between(first, last) for s in range(salts)]
            first, held = None, 0
        first, last, held = h if first is None else first, h, held + n
    return out


def _above(reps: DataFrame, index, dim: int, k: int, floor: float, mutual: bool) -> DataFrame:
    """(q, x, cosine): the k best from the floor on of each query within each portion of the index and each task.

    No row travels: the index rows are held portion by portion, each by every worker, and meet a scan of the
    queries. Where all rows ask (mutual), a pair is compared once, from the earlier list, and counts for both sides.
    """
    spark = reps.sparkSession
    wide = math.acos(min(1.0, floor)) + 5 * ROUNDING

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column(1), dim)) if batch.num_rows else np.zeros((0, dim), np.float32)
            home = [np.argmax(x[a : a + 4096] @ index.value.centroids.T, 1) for a in range(0, len(x), 4096)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*home, np.zeros(0)]).astype(np.int32)), batch.column(2), _binary(x)], names=["no", "home", "asks", "x"])

    rows = materialize(reps.select("no", "v", "asks").mapInArrow(assign, "no bigint, home int, asks boolean, x binary"), dictionary=False)

    def near(portion: Column) -> tuple[DataFrame, Broadcast]:
        held = spark.sparkContext.broadcast(_held(rows.filter(portion).select("no", "home", "x").toArrow(), index.value, dim))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix, (lists, low, high, angle, held_no, held_x) = index.value, held.value
            others = _Best(len(held_no) if mutual else 0, k)
            for some in (batch.slice(at, 8192) for batch in batches for at in range(0, batch.num_rows, 8192)):
                no, home, x = some.column(0).to_numpy(), some.column(1).to_numpy(), _vectors(some.column(2), dim)
                best = _Best(len(no), k)
                reached, cosine = ix.within(x, home, lists, floor)
                if mutual:
                    reached &= lists >= home[:, None]
                for j in np.flatnonzero(reached.any(0)):
                    w = np.flatnonzero(reached[:, j])
                    to = np.arccos(np.clip(cosine[w, j], -1, 1))
                    by = np.argsort(to, kind="stable")
                    w, to = w[by], to[by]
                    for b in range(0, len(w), TOGETHER):
                        # No row within the floor's angle of a query differs more from it in its angle to the centroid.
                        q, ends = w[b : b + TOGETHER], (to[b] - wide, to[min(b + TOGETHER, len(w)) - 1] + wide)
                        first, last = (low[j] + np.searchsorted(angle[low[j] : high[j]], e, s) for e, s in zip(ends, ("left", "right")))
                        for c in range(first, last, PART_ROWS):
                            score = x[q] @ held_x[c : min(last, c + PART_ROWS)].T
                            at_q, at_x = np.nonzero(score >= np.float32(floor))
                            if not len(at_q):
                                continue
                            value, at_q, at_x = score[at_q, at_x], q[at_q], c + at_x
                            once = (home[at_q] != lists[j]) | (no[at_q] < held_no[at_x]) if mutual else no[at_q] != held_no[at_x]
                            value, at_q, at_x = value[once], at_q[once], at_x[once]
                            best.add(at_q, value, held_no[at_x])
                            if mutual:
                                others.add(at_x, value, no[at_q])
                yield best.rows(no)
            yield others.rows(held_no)

        asking = rows.select("no", "home", "x") if mutual else rows.filter("asks").select("no", "home", "x")
        return spread(asking, "no").mapInArrow(scan, FOUND), held

    portions = _portions(rows, max(1, HELD_FLOATS // dim))
    if len(portions) == 1:
        return near(portions[0])[0]
    parts = []
    for portion in portions:
        found, held = near(portion)
        parts.append(materialize(found))
        held.destroy()
    return union_all(parts)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column of their bytes, none null."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(-1, dim) if len(column) else np.zeros((0, dim), np.float32)


def _held(t: pa.Table, index: Index, dim: int) -> tuple[np.ndarray, ...]:
    """(lists, low, high, angle, no, x) of index rows: by list, there by their angle to its centroid."""
    no, home = t.column("no").to_numpy(), t.column("home").to_numpy()
    x = np.concatenate([np.zeros((0, dim), np.float32), *(_vectors(c, dim) for c in t.column("x").chunks)])
    angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, index.centroids[home]), -1, 1))
    order = np.lexsort((angle, home))
    lists = np.unique(home)
    low, high = (np.searchsorted(home[order], lists, s) for s in ("left", "right"))
    return lists, low, high, angle[order], no[order], x[order]


class _Best:
    """The k best answers of each query so far: their cosines, best first, and their rows."""

    def __init__(self, queries: int, k: int) -> None:
        self.cosine = np.full((queries, k), -np.inf, np.float32)
        self.row = np.full((queries, k), -1, np.int64)

    def add(self, at: np.ndarray, cosine: np.ndarray, row: np.ndarray) -> None:
        k = self.row.shape[1]
        good = cosine >= self.cosine[at, -1]
        at, cosine, row = at[good], cosine[good], row[good]
        if not len(at):
            return
        hit = np.unique(at)
        q, v, r = np.concatenate([at, np.repeat(hit, k)]), np.concatenate([cosine, self.cosine[hit].ravel()]), np.concatenate([row, self.row[hit].ravel()])
        by = np.lexsort((r, -v, q))
        q, v, r = q[by], v[by], r[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = rank < k
        self.cosine[q[keep], rank[keep]], self.row[q[keep], rank[keep]] = v[keep], r[keep]

    def rows(self, no: np.ndarray) -> pa.RecordBatch:
        q, k = np.nonzero(np.isfinite(self.cosine))
        return pa.RecordBatch.from_arrays([pa.array(no[q], pa.int64()), pa.array(self.row[q, k]), pa.array(self.cosine[q, k])], names=["q", "x", "cosine"])


def most_similar(df: DataFrame, ident: str, vector: str, k: int = K, probes: float = PROBES, floor: float = -2.0, asks: Column | None = None, dim: int | None = None) -> DataFrame:
    """(id, neighbour, rank, cosine): for each id the k other rows with the most similar vectors among those found.

    probes: lists that a query looks into (under 1: share of all lists) where no floor is given. floor:
    cosines below it are not reported (ranks are among all, as a higher cosine ranks before), and all
    lists that may hold one above it are looked into. asks: which rows are queries, null
    counts as no; all by default. Null, zero and non-finite vectors and other lengths than the most
    frequent take no part; ids must be unique. Exact copies are searched once: a copy's neighbours are
    its first k other copies by id, then those of its class. Ties go by id. Without a floor approximate: a
    neighbour in a list that isn't probed is missed. The index is fitted on at most SAMPLE vectors, every one is in it.
    """
    spark = df.sparkSession
    vectors, dim = usable_vectors(df, ident, vector, dim)
    classes = vectors.groupBy("k1", "k2").agg(F.min("no").alias("rep"), F.count("*").alias("copies"))
    kind = vectors.schema["id"].dataType
    members = vectors.select("id", "no", "k1", "k2", (F.coalesce(asks, F.lit(False)) if asks is not None else F.lit(True)).alias("asks"))
    members = materialize(members.join(classes, ["k1", "k2"]).select("id", "no", "rep", "copies", "asks"))
    counts = members.agg(F.count_if(F.col("no") == F.col("rep")).alias("n"), F.max("copies").alias("c"), F.count_if("asks").alias("asking")).first()
    total, copied = counts["n"], (counts["c"] or 0) > 1
    if not total:
        return spark.createDataFrame([], f"id {kind.simpleString()}, neighbour {kind.simpleString()}, rank int, cosine float")
    if copied:
        wanted = members.groupBy("rep").agg(F.max("asks").alias("asks"))
        reps = vectors.select("no", "v").join(wanted.withColumnRenamed("rep", "no"), "no")
    else:
        reps = vectors.select("no", "v").join(members.select("no", "asks"), "no") if asks is not None else vectors.select("no", "v", F.lit(True).alias("asks"))
    sample = _sample(reps, total, dim)
    fitted = Index.fit(sample, total)
    if floor > -1:
        found = _above(reps, spark.sparkContext.broadcast(fitted), dim, k, floor, asks is None)
    else:
        index = spark.sparkContext.broadcast(fitted.plan(sample, min(total, counts["asking"]), probes))
        found = _search(_route(reps, index, dim, probes), index, k)
    if copied:
        first = W.partitionBy("rep").orderBy("id")
        some = members.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= k + 1).select(F.col("rep").alias("x"), F.col("id").alias("neighbour"))
        twins = members.filter("copies > 1 AND no = rep").select(F.col("rep").alias("q"), F.col("rep").alias("x"), F.lit(1.0).cast("float").alias("cosine"))
        near = found.unionByName(twins).join(some, "x").join(members.filter("asks").select(F.col("rep").alias("q"), "id"), "q")
    else:
        near = found.join(members.select(F.col("no").alias("x"), F.col("id").alias("neighbour")), "x").join(members.select(F.col("no").alias("q"), "id"), "q")
    near = near.filter((F.col("id") != F.col("neighbour")) & (F.col("cosine") >= floor))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return near.select("id", "neighbour", "cosine", rank.alias("rank")).filter(F.col("rank") <= k).select("id", "neighbour", "rank", "cosine")


def divisible_by_100(hex_id: Column) -> Column:
    """Is the number that a hexadecimal id of 24 digits states divisible by 100?"""
    half = lambda at: F.conv(F.substring(hex_id, at, 12), 16, 10).cast("bigint") % 100
    return (half(1) * (2**48 % 100) + half(13)) % 100 == 0


def similar_pairs(df: DataFrame, ident: str, vector: str, cosine: float = 0.9, k: int = K) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs with at least this cosine of which one is among the k most similar of the other."""
    near = most_similar(df, ident, vector, k, floor=cosine)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
