"""Evaluation texts that leaked into a corpus, by greedy string tiling with Karp-Rabin seeds."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvist.session import broadcast_if_small, materialize, spread

#: Shortest tile in words; the run of words, and the share of a passage under tiles, that count as a leak.
SEED, RUN, COVERAGE = 6, 12, 0.5
#: Characters of test passages that a worker holds; more are met by a join of their seeds.
HELD_CHARS = 4_000_000
#: Documents that share one seed and are joined with its passages in one group; more are salted.
HEAVY = 20_000
#: Distinct words whose codes a worker keeps; it starts anew beyond that, which changes no code.
KEPT_WORDS = 200_000

_BASE = 0x9E3779B97F4A7C15 | 1
_WORDS = re.compile("[0-9a-zæøå]+").findall


def words(text: str | None) -> list[str]:
    """Runs of digits and letters in the lower-cased text; null has none."""
    return _WORDS(text.lower()) if text else []


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin values, modulo 2 ** 64, of all windows of ``width`` codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, base = np.zeros(n, np.uint64), np.uint64(_BASE)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    for k in range(width):
        out = out * base + mixed[k : k + n]
    return out


class Passages:
    """Test passages, indexed by the Karp-Rabin values of their windows."""

    def __init__(self, items: list[tuple[int, str | None]], seed: int = SEED) -> None:
        self.seed, self.code = seed, {}
        self.items = [i for i, _ in items]
        self.texts = [np.array([self.code.setdefault(w, len(self.code) + 1) for w in words(t)], np.int64) for _, t in items]
        values = [rolling(c, seed) for c in self.texts]
        self.value = np.concatenate(values) if values else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(values)), [len(v) for v in values]) if values else np.zeros(0, np.int64)
        self.place = np.concatenate([np.arange(len(v)) for v in values]) if values else np.zeros(0, np.int64)
        order = np.argsort(self.value, kind="stable")
        self.value, self.owner, self.place = self.value[order], self.owner[order], self.place[order]

    def tiles(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(passage, longest, words under tiles, tiles) of each passage that shares a seed with a text."""
        values = rolling(codes, self.seed)
        low, high = np.searchsorted(self.value, values, "left"), np.searchsorted(self.value, values, "right")
        hits = np.flatnonzero(high > low)
        if not len(hits):
            return
        count = high[hits] - low[hits]
        at = np.repeat(low[hits] - np.cumsum(count) + count, count) + np.arange(count.sum())
        place, owner = np.repeat(hits, count), self.owner[at]
        shift = place - self.place[at]
        order = np.lexsort((place, shift, owner))
        place, owner, shift = place[order], owner[order], shift[order]
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(owner) != 0) | (np.diff(shift) != 0)]))
        ends = np.concatenate([begins[1:], [len(place)]])
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for b, e in zip(begins.tolist(), ends.tolist()):
            p, d, n = int(owner[b]), int(place[b]), e - b + self.seed - 1
            s = d - int(shift[b])
            if np.array_equal(codes[d : d + n], self.texts[p][s : s + n]):
                runs.setdefault(p, []).append((-n, s, d))
        for p, found in runs.items():
            yield (p, *_tile(found, len(self.texts[p]), self.seed))


def _tile(runs: list[tuple[int, int, int]], size: int, least: int) -> tuple[int, int, int]:
    """Greedy string tiling of maximal matches (-length, place in passage, place in text): the longest first, without overlap.

    A match that is partly covered is cut to its free stretches, which are tried again by their length.
    """
    heapq.heapify(runs)
    in_passage, in_text = np.zeros(size, bool), set()
    longest = covered = tiles = 0
    while runs:
        n, s, d = heapq.heappop(runs)
        n = -n
        free = [not in_passage[s + k] and (d + k) not in in_text for k in range(n)]
        if all(free):
            in_passage[s : s + n] = True
            in_text.update(range(d, d + n))
            longest, covered, tiles = max(longest, n), covered + n, tiles + 1
            continue
        k = 0
        while k < n:
            if free[k]:
                e = k
                while e < n and free[e]:
                    e += 1
                if e - k >= least:
                    heapq.heappush(runs, (-(e - k), s + k, d + k))
                k = e
            else:
                k += 1
    return longest, covered, tiles


def leaked_passages(documents: DataFrame, passages: DataFrame, run: int = RUN, coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """(doc_id, item_id, longest, covered, tiles, coverage) of each document and each passage that leaked into it.

    A passage leaked if ``run`` of its words follow each other in the document, or if tiles of at least
    ``seed`` words cover the share ``coverage`` of it, in any order. Words are compared, so layout,
    case and punctuation don't count. Passages with fewer words than ``seed`` can't leak; null, empty
    and blank texts have no words. Whole texts are searched, and equal documents are each reported. Passages
    of up to HELD_CHARS are held by every worker, and documents are read once, without shuffle; more
    passages meet the documents by their seeds (see _joined). item_id must be unique.
    """
    texts = passages.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > HELD_CHARS:
        return _joined(documents, texts, run, coverage, seed)
    held = [(r["item_id"], r["text"]) for r in texts.filter("text IS NOT NULL").collect()]
    return _search(documents, documents.sparkSession.sparkContext.broadcast(held), run, coverage, seed)


class _Codes(dict):
    """64-bit codes of words, the same in every task."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        code = self[word] = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
        return code


def _seeds(df: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, seed, times): the distinct Karp-Rabin values of each text's windows of ``seed`` words, and in how many of them each occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                coded = (np.fromiter(map(codes.__getitem__, words(t.as_py())), np.uint64) for t in some.column(1))
                values, times = zip(*(np.unique(rolling(c, seed), return_counts=True) for c in coded))
                n = [len(v) for v in values]
                cols = [some.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.concatenate(values).view(np.int64)), pa.array(np.concatenate(times).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "seed", "times"])

    return df.select(key, "text").mapInArrow(work, f"{key} bigint, seed bigint, times bigint")


def _joined(documents: DataFrame, passages: DataFrame, run: int, coverage: float, seed: int) -> DataFrame:
    """leaked_passages by a join of shared seeds; only pairs that share enough of them are tiled.

    A run of ``run`` words has run - seed + 1 windows in the passage, and tiles that cover the share ``coverage`` of a
    passage one for each 2 * ``seed`` words at least; pairs with fewer can't be a leak. Seeds of many documents are salted.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = materialize(documents.select("doc_id", "text", F.monotonically_increasing_id().alias("no")).filter("text IS NOT NULL"))
    own = materialize(_seeds(passages, "item_id", seed))
    hits = materialize(_seeds(docs, "no", seed).drop("times").join(broadcast_if_small(own.select("seed").distinct()), "seed", "left_semi"))
    salts = materialize(hits.groupBy("seed").agg(F.ceil(F.count("*") / HEAVY).cast("int").alias("salts")))
    heavy = broadcast_if_small(materialize(salts.filter("salts > 1")))
    hits = hits.join(heavy, "seed", "left").withColumn("salt", F.pmod(F.xxhash64("no"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    spread_own = own.join(salts, "seed").select("seed", "item_id", "times", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    shared = hits.join(spread_own, ["seed", "salt"]).groupBy("no", "item_id").agg(F.sum("times").alias("shared"))
    size = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-zæøå]+"), F.lit(0)))
    texts = passages.select("item_id", F.col("text").alias("passage"), F.least(F.lit(max(1, run - seed + 1)), F.greatest(F.lit(1), F.ceil(size * coverage / (2 * seed)))).alias("least"))
    pairs = shared.join(texts, "item_id").filter("shared >= least").join(docs, "no").select("doc_id", "text", "item_id", "passage")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (text, item, passage) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                index = Passages([(item, passage)], seed)
                out += [(k, *f) for f in _leaks(index, text, run, coverage)]
            yield _leak_batch(batch.column(0).take(pa.array([r[0] for r in out], pa.int64())), [r[1:] for r in out])

    return pairs.mapInArrow(work, _LEAKS.format(kind))


_LEAKS = "doc_id {}, item_id bigint, longest int, covered int, tiles int, coverage double"


def _leaks(index: Passages, text: str | None, run: int, coverage: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(item, longest, covered, tiles, share) of each passage that leaked into a text."""
    codes = np.fromiter((index.code.get(w, 0) for w in words(text)), np.int64)
    for p, longest, covered, tiles in index.tiles(codes):
        share = covered / len(index.texts[p])
        if longest >= run or share >= coverage:
            yield index.items[p], longest, covered, tiles, share


def _leak_batch(docs: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    return pa.RecordBatch.from_arrays([docs, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "item_id", "longest", "covered", "tiles", "coverage"])


def _search(documents: DataFrame, own, run: int, coverage: float, seed: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Passages(own.value, seed)
        for batch in batches:
            out = [(k, *f) for k, text in enumerate(batch.column(1)) for f in _leaks(index, text.as_py(), run, coverage)]
            yield _leak_batch(batch.column(0).take(pa.array([r[0] for r in out], pa.int64())), [r[1:] for r in out])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(work, _LEAKS.format(documents.schema["doc_id"].dataType.simpleString()))
