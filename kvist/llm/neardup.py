"""Near-duplicate records with small edits: an exact set-similarity join that skips by set relations.

Sets of word sequences are compared by Jaccard similarity. Equal sets are one. A global order of the
sequences gives each set a prefix that it must share with any similar one: hashes in their order, those
that occur often behind them by their weight. Two relations save work:

* An index list is sorted by the position that the sequence has in its sets and cut into blocks; a pair of
  blocks whose best case can't reach the needed overlap is skipped as a whole.
* A set that differs from another one, its leader, in a few elements is not searched for on its own:
  it probes only with the prefix elements that its leader's prefix lacks, and its other answers are derived
  from the leader's, whose overlaps are corrected by the few elements in which both differ.

The result is exact but for collisions of 64-bit hashes of the sequences (about n * n / 2 ** 65 for n
different sequences); it doesn't depend on the weights, which only order the sequences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvist.session import broadcast_if_small, materialize, spread

#: Words of a sequence, least words of a record, and the similarity as production parameters of the chunk table.
SHINGLE, LEAST_WORDS, SIMILARITY = 3, 20, "0.6"
#: Entries of a block of an index list; share of a set in which a follower may differ from its leader.
BLOCK, FOLLOW = 64, 0.1
#: Entries of one list that a task compares with one another; a list of more meets itself in a grid of bands.
BAND = 16_384
#: Least weight of a sequence that is ordered by it, and how many such sequences there are at most (least weights grow for that).
LIGHT, MOST_WEIGHTS = 4, 500_000
#: Hashes under which a set's least element is one of its marks; the first one finds its leader, all of them its first links.
MARKS = 4
#: Rows, and bytes of texts or sets, that are worked on at once.
PORTION_ROWS, PORTION_BYTES = 2048, 8 << 20
#: Sequences that a task gathers before it counts them, and distinct words whose codes it keeps.
COUNTED, KEPT_WORDS = 1 << 22, 200_000

_WORDS = re.compile("[0-9a-zæøå]+").findall
#: Items are 64-bit numbers, one after the other, as bytes: nothing in the JVM looks into them.
_SETS = "ord bigint, n int, items binary, k1 bigint, k2 bigint, marks array<bigint>, counts binary"
#: An entry: its list, its set, n / rest / whole / crossed / side, how far lo, hi and slack are from n, n and 0, and the bitmap.
_ENTRIES = "list bigint, id bigint, place bigint, span bigint, b0 bigint, b1 bigint"
#: Largest distance that span holds; from it on a distance counts as unlimited.
_FAR = (1 << 21) - 1


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in portions of at most PORTION_ROWS rows and about PORTION_BYTES of a column, so that long rows don't add up."""
    at = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > at and (held + n > PORTION_BYTES or i - at >= PORTION_ROWS):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if batch.num_rows:
        yield batch.slice(at)


class _Codes(dict):
    """64-bit codes of words; starts anew when it holds KEPT_WORDS, which changes no code."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        code = self[word] = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
        return code


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (splitmix64's finish)."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets(texts: list[str | None], codes: _Codes, shingle: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, begins, items): the texts with enough words, and their sorted distinct sequences one after the other."""
    words, rows, sizes = [], [], []
    for k, text in enumerate(texts):
        own = _WORDS(text.lower()) if text else ()
        if len(own) >= max(least, shingle):
            words += own
            rows.append(k)
            sizes.append(len(own))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    code = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    ends = np.cumsum(sizes)
    value = np.zeros(len(code) - shingle + 1, np.uint64)
    for k in range(shingle):
        value = value * np.uint64(0x9E3779B97F4A7C15) + code[k : len(code) - shingle + 1 + k]
    value = _mix(value, 1).view(np.int64)
    parts = [value[e - s : e - shingle + 1] for s, e in zip(sizes, ends.tolist())]
    for p in parts:
        p.sort()
    items = np.concatenate(parts)
    begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    new = np.ones(len(items), bool)
    new[1:] = items[1:] != items[:-1]
    new[begins[:-1]] = True
    return np.array(rows), np.concatenate([[0], np.cumsum(np.add.reduceat(new, begins[:-1]))]), items[new]


def shingle_sets(df: DataFrame, order: str, text: str, shingle: int = SHINGLE, least: int = LEAST_WORDS) -> DataFrame:
    """The distinct hashed word sequences of each record with at least ``least`` words, in one pass over the texts.

    (ord, n, items, k1, k2, marks) of a set, where (k1, k2, n) tells equal sets and marks are its least elements under
    other hashes. Rows without ord hold sequences (items) and how often a task met them (counts), from two on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen, held = _Codes(), [], 0
        names = [f.split()[0] for f in _SETS.split(", ")]

        def weights() -> pa.RecordBatch:
            tok, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.int64), return_counts=True)
            often = n > 1
            none = pa.nulls(1, pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.nulls(1, pa.int32()), pa.array([tok[often].tobytes()]), none, none, pa.nulls(1, pa.list_(pa.int64())), pa.array([n[often].tobytes()])], names=names)

        for batch in batches:
            for some in _portions(batch, 1):
                rows, begins, items = _sets(some.column(1).to_pylist(), codes, shingle, least)
                if not len(rows):
                    continue
                bits, first = items.view(np.uint64), begins[:-1]
                keys = [pa.array(np.add.reduceat(_mix(bits, k), first).view(np.int64)) for k in (2, 3)]
                marks = np.stack([np.minimum.reduceat(_mix(bits, 10 + k), first).view(np.int64) for k in range(MARKS)], 1)
                marks = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * MARKS, pa.int32()), pa.array(marks.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows)), pa.array(np.diff(begins), pa.int32()), _packed(items, begins), *keys, marks, pa.nulls(len(rows), pa.binary())], names=names)
                seen.append(items)
                held += len(items)
                if held >= COUNTED:
                    yield weights()
                    seen, held = [], 0
        if seen:
            yield weights()

    rows = spread(df.select(F.col(order).cast("long").alias("ord"), text).filter("ord IS NOT NULL"), "ord")
    return rows.mapInArrow(run, _SETS)


class _Order:
    """The global order: sequences without weight by their hash, then the others by weight and hash."""

    def __init__(self, tok: np.ndarray, weight: np.ndarray) -> None:
        by = np.argsort(tok)
        self.tok, self.weight = tok[by], weight[by]

    def of(self, items: np.ndarray) -> np.ndarray:
        """The weight of each sequence; 0 for most."""
        if not len(self.tok):
            return np.zeros(len(items), np.int64)
        at = np.minimum(np.searchsorted(self.tok, items), len(self.tok) - 1)
        return np.where(self.tok[at] == items, self.weight[at], 0)

    def prefixes(self, items: np.ndarray, begins: np.ndarray, share: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, sequence, weight, sequences after it) of all sets' prefixes."""
        n = np.diff(begins)
        row = np.repeat(np.arange(len(n)), n)
        weight = self.of(items)
        order = np.argsort((row << 32) + weight, kind="stable")
        place = np.arange(len(items)) - np.repeat(begins[:-1], n)
        width = n + (-n * share.numerator // share.denominator) + 1
        keep = place < width[row]
        order = order[keep]
        return row[keep], items[order], weight[order], (n[row] - place - 1)[keep]


def _bitmaps(items: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements in 128 cells, as two words a set: where those of two sets differ, one set has an element that the other lacks."""
    cell = (_mix(items.view(np.uint64), 5) & np.uint64(127)).astype(np.int64)
    bit = np.uint64(1) << (cell & 63).astype(np.uint64)
    zero = np.uint64(0)
    return np.stack([np.bitwise_xor.reduceat(np.where(cell >> 6 == k, bit, zero), begins[:-1]) for k in (0, 1)]).view(np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, begins) of a column of lists or of packed numbers, without nulls."""
    if pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
        return np.frombuffer(column.buffers()[2], np.int64)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.int64), (offsets - offsets[0]).astype(np.int64)
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _packed(items: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer((begins * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(items))])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many parities of two bitmaps differ."""
    return np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64)


def _entry_batch(tok, weight, ident, whole, n, lo, hi, slack, rest, bitmap, component=(), band: int = BAND) -> pa.RecordBatch:
    """Index entries; an entry of a long list goes to each cell of the grid that its band meets."""
    n, lo, hi, slack, rest = (v.astype(np.int64) for v in (n, lo, hi, slack, rest))
    bands = -(-weight // band)
    many = np.flatnonzero(bands > 1)
    copies = np.ones(len(tok), np.int64)
    copies[many] = bands[many]
    k = np.repeat(np.arange(len(tok)), copies)
    other = np.arange(len(k)) - np.repeat(np.cumsum(copies) - copies, copies)
    own = np.where(bands[k] > 1, (_mix(ident[k].view(np.uint64), 6) % np.maximum(bands[k], 1).astype(np.uint64)).astype(np.int64), 0)
    low, high = np.minimum(own, other), np.maximum(own, other)
    cell = np.where(bands[k] > 1, _mix(((low << 31) + high + 1).view(np.uint64), 7).view(np.int64), 0)
    place = (n << 34) + (rest << 3) + whole * 4  # a set has fewer than 2 ** 29 elements
    far = lambda x: np.minimum(x, _FAR)
    span = (far(n - lo) << 42) + (far(hi - n) << 21) + far(slack)
    cols = [tok[k] ^ cell, ident[k], place[k] + (low < high) * 2 + (own > other), span[k], bitmap[0][k], bitmap[1][k], *(c[k] for c in component)]
    names = [f.split()[0] for f in _ENTRIES.split(", ")] + ["component"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names[: len(cols)])


def _read_entries(t: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The fields of index entries."""
    x = {n: t.column(k).to_numpy() for k, n in enumerate(t.schema.names)}
    place, span = x.pop("place"), x.pop("span")
    wide = lambda v: np.where(v == _FAR, 1 << 31, v)
    x |= {"n": place >> 34, "rest": place >> 3 & (1 << 31) - 1, "whole": (place & 4) > 0, "crossed": (place & 2) > 0, "side": place & 1}
    return x | {"lo": np.maximum(x["n"] - wide(span >> 42), 1), "hi": x["n"] + wide(span >> 21 & _FAR), "slack": wide(span & _FAR)}


def _needed(total, share: Fraction):
    """The least overlap of two similar sets with ``total`` elements together."""
    return -(-total * share.numerator // (share.numerator + share.denominator))


def _fits(x: dict, a: np.ndarray, b: np.ndarray, share: Fraction) -> np.ndarray:
    """Can the sets that entries a and b represent be similar, with this sequence as the first they share?"""
    num, den = share.numerator, share.denominator
    least = _needed(x["lo"][a] + x["lo"][b], share)
    good = np.minimum(x["rest"][a] + x["slack"][a], x["rest"][b] + x["slack"][b]) + 1 >= least
    return good & (x["hi"][a] * den >= x["lo"][b] * num) & (x["hi"][b] * den >= x["lo"][a] * num)


def _similar_enough(x: dict, a: np.ndarray, b: np.ndarray, share: Fraction) -> np.ndarray:
    """The same by the sets' bitmaps: each differing parity is an element outside the overlap."""
    apart = sum(_apart(x[c][a], x[c][b]) for c in ("b0", "b1"))
    most = (x["n"][a] + x["n"][b] - apart) // 2 + x["slack"][a] + x["slack"][b]
    return most >= _needed(x["lo"][a] + x["lo"][b], share)


def _meet(x: dict, begins: np.ndarray, share: Fraction, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries within each list that can't be excluded, block by block."""
    size = np.diff(begins)
    if "component" in x:  # a list of one component holds no pair that is looked for
        size = np.where(np.minimum.reduceat(x["component"], begins[:-1]) == np.maximum.reduceat(x["component"], begins[:-1]), 1, size)
    small = np.repeat((size > 1) & (size <= most), np.diff(begins))
    last = np.repeat(begins[1:], np.diff(begins))
    at = np.flatnonzero(small)
    step = 1
    while len(at):
        at = at[at + step < last[at]]
        yield at, at + step
        step += 1
    for g in np.flatnonzero(size > most):
        by = begins[g] + np.argsort(x["rest"][begins[g] : begins[g + 1]], kind="stable")
        cuts = np.arange(0, len(by), most)
        of = lambda f, c: f.reduceat(x[c][by], cuts)
        block = {"lo": of(np.minimum, "lo"), "hi": of(np.maximum, "hi"), "slack": of(np.maximum, "slack"), "rest": of(np.maximum, "rest")}
        for i in range(len(cuts)):
            js = np.arange(i, len(cuts))
            for j in js[_fits(block, np.full(len(js), i), js, share)]:
                p, q = by[cuts[i] : cuts[i] + most], by[cuts[j] : cuts[j] + most]
                a, b = np.repeat(p, len(q)), np.tile(q, len(p))
                yield (a[a < b], b[a < b]) if i == j else (a, b)


def _candidates(share: Fraction, most: int):
    """Reads index entries sorted by list, and gives the pairs of ids that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None

        def work(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, found = _read_entries(t), []
            new = np.ones(t.num_rows, bool)
            new[1:] = x["list"][1:] != x["list"][:-1]
            for a, b in _meet(x, np.append(np.flatnonzero(new), t.num_rows), share, most):
                keep = (x["id"][a] != x["id"][b]) & (~x["crossed"][a] | (x["side"][a] != x["side"][b])) & _fits(x, a, b, share)
                if "component" in x:
                    keep &= x["component"][a] != x["component"][b]
                a, b = a[keep], b[keep]
                keep = _similar_enough(x, a, b, share)
                a, b = a[keep], b[keep]
                flip = x["id"][a] > x["id"][b]
                a, b = np.where(flip, b, a), np.where(flip, a, b)
                if len(a):
                    found.append((x["id"][a], x["id"][b], x["whole"][a], x["whole"][b]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b", "wa", "wb"])

        for batch in batches:
            t = pa.Table.from_batches([left, batch] if left is not None else [batch]).combine_chunks().to_batches()[0] if batch.num_rows else left
            if t is None:
                continue
            key = t.column(0).to_numpy()
            last = np.flatnonzero(key != key[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            left = t.slice(cut)
            if cut:
                yield from work(t.slice(0, cut))
        if left is not None and left.num_rows:
            yield from work(left)

    return run


_SEEN = "a bigint, b bigint, na int, nb int, ta array<bigint>, tb array<bigint>, both int, ga boolean, gb boolean, direct boolean, again boolean"


def _verified(share: Fraction, every: bool):
    """Counts the common elements of pairs (a, b, ta, tb, la, lb, sa, sb) and keeps those that are similar or speak for sets that may be.

    l: the least size of the sets that a side speaks for, s: its slack, or -1 where it speaks for itself alone. Only rows
    that are looked at ``again`` keep their elements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _portions(b, 2)):
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            (ta, at), (tb, bt) = _lists(batch.column(2)), _lists(batch.column(3))
            la, lb, sa, sb = (batch.column(k).to_numpy().astype(np.int64) for k in range(4, 8))
            na, nb = np.diff(at), np.diff(bt)
            both = np.array([len(np.intersect1d(ta[at[i] : at[i + 1]], tb[bt[i] : bt[i + 1]], True)) for i in range(len(a))])
            direct = (both >= _needed(na + nb, share)) & (a != b)
            ga, gb = sa >= 0, sb >= 0
            again = (ga | gb) & (both >= _needed(la + lb, share) - np.maximum(sa, 0) - np.maximum(sb, 0))
            again = again if every else again & ~direct
            k = np.flatnonzero(direct | again)
            part = lambda t, at: pa.array([t[at[i] : at[i + 1]] if again[i] else None for i in k], pa.list_(pa.int64()))
            i32 = lambda x: pa.array(x[k].astype(np.int32))
            cols = [pa.array(a[k]), pa.array(b[k]), i32(na), i32(nb), part(ta, at), part(tb, bt), i32(both), *(pa.array(x[k]) for x in (ga, gb, direct, again))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in _SEEN.split(", ")])

    return run


class SimilarityJoin:
    """All pairs of sets with a Jaccard similarity of at least ``similarity``; see the module. sets: what shingle_sets gives."""

    def __init__(self, sets: DataFrame, similarity: str = SIMILARITY) -> None:
        self.share = Fraction(similarity)
        if not 0 < self.share <= 1:
            raise ValueError("similarity must be over 0 and at most 1")
        self.num, self.den = self.share.numerator, self.share.denominator
        self.block, self.band = BLOCK, BAND
        rows = materialize(sets, dictionary=False)
        keyed = rows.filter("counts IS NULL")
        keys = keyed.select("ord", "n", "k1", "k2", "marks")
        classes = keys.groupBy("k1", "k2", "n").agg(F.min("ord").alias("rep"))
        known = materialize(keys.join(classes, ["k1", "k2", "n"]).select("ord", "rep", "marks"))
        #: (ord, rep): the least record with the same set.
        self.members = known.select("ord", "rep")
        self.reps = known.filter("ord = rep").select(F.col("ord").alias("id"), "marks")
        self.sets = keyed.select(F.col("ord").alias("id"), "n", "items")
        self.order = keyed.sparkSession.sparkContext.broadcast(self._weights(rows))

    @staticmethod
    def _weights(rows: DataFrame) -> _Order:
        """Sequences that occur often, at most MOST_WEIGHTS, as all weights together are at most the number of all elements."""
        total = rows.filter("counts IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        least = max(LIGHT, -(-total // MOST_WEIGHTS))

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_lists(batch.column(k))[0]) for k in (0, 1)], names=["tok", "n"])

        seen = rows.filter("counts IS NOT NULL").select("items", "counts").mapInArrow(unpack, "tok bigint, n bigint").groupBy("tok").agg(F.sum("n").alias("weight"))
        t = seen.filter(F.col("weight") >= least).toArrow()
        return _Order(t.column(0).to_numpy(), t.column(1).to_numpy())

    def similar(self, overlap: Column, total: Column) -> Column:
        return overlap * (self.num + self.den) >= total * self.num

    def _of(self, ids: DataFrame, as_: str, items: str, n: str) -> DataFrame:
        """The sets of ids (id), whose scan is filtered before anything is shuffled where the ids are few."""
        return self.sets.join(broadcast_if_small(ids), "id").select(F.col("id").alias(as_), F.col("items").alias(items), F.col("n").alias(n))

    def _led(self, every: bool) -> DataFrame:
        """(id, leader, first): the least set with the same mark leads the others; by the first mark alone if every."""
        marked = self.reps.select("id", F.posexplode(F.slice("marks", 1, 1 if every else MARKS)).alias("k", "mark"))
        heads = marked.groupBy("k", "mark").agg(F.min("id").alias("leader"), F.count("*").alias("many")).filter("many > 1").drop("many")
        pairs = marked.join(heads, ["k", "mark"]).filter("id <> leader").select("id", "leader", (F.col("k") == 0).alias("first"))
        return materialize(pairs if every else pairs.groupBy("id", "leader").agg(F.max("first").alias("first")))

    def _followers(self, every: bool) -> DataFrame:
        """(id, leader, n, follows, plus, minus, more, tok, weight, rest, b0, b1): sets that differ from their leader in few elements.

        plus, minus: the elements in which they differ. tok, weight, rest: the prefix elements that the leader's prefix
        lacks. Unless every, only sets that are similar to their leader follow it, and other similar ones are here, too.
        """
        order, share = self.order, self.share

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (p for b in batches for p in _portions(b, 2)):
                ident, leader, first = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
                (items, begins), (led, led_begins) = _lists(batch.column(2)), _lists(batch.column(3))
                bits = _bitmaps(items, begins)
                # Most sets of one mark differ too much; their bitmaps tell that.
                n, led_n = np.diff(begins), np.diff(led_begins)
                apart = sum(map(_apart, bits, _bitmaps(led, led_begins)))
                near = apart <= np.maximum(1, FOLLOW * led_n) if every else (n + led_n - apart) // 2 >= _needed(n + led_n, share)
                row, tok, weight, rest = order.value.prefixes(items, begins, share)
                at = np.searchsorted(row, np.arange(len(ident) + 1))
                led_row, led_tok, _, _ = order.value.prefixes(led, led_begins, share)
                led_at = np.searchsorted(led_row, np.arange(len(ident) + 1))
                out, none = [], np.zeros(0, np.int64)
                for i in np.flatnonzero(near):
                    own, lead = items[begins[i] : begins[i + 1]], led[led_begins[i] : led_begins[i + 1]]
                    plus = np.setdiff1d(own, lead, True)
                    both = len(own) - len(plus)
                    close = len(plus) + len(lead) - both <= max(1.0, FOLLOW * len(lead))
                    linked = both >= _needed(len(own) + len(lead), share)
                    if close and first[i] and (every or linked):
                        p = slice(at[i], at[i + 1])
                        new = ~np.isin(tok[p], led_tok[led_at[i] : led_at[i + 1]])
                        out.append((ident[i], leader[i], len(own), True, plus, np.setdiff1d(lead, own, True), len(plus), tok[p][new], weight[p][new], rest[p][new], bits[0][i], bits[1][i]))
                    elif linked and not every:
                        out.append((ident[i], leader[i], len(own), False, none, none, 0, none, none, none, 0, 0))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.list_(pa.int64())] * 2, pa.int32(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names="id leader n follows plus minus more tok weight rest b0 b1".split())

        led = self._led(every)
        own = self._of(materialize(led.select("id").distinct()) if not every else led.select("id"), "id", "items", "n").join(led, "id")
        lead = self._of(materialize(led.select(F.col("leader").alias("id")).distinct()), "leader", "lead", "ln")
        pairs = own.join(lead, "leader").select("id", "leader", "items", "lead", "first")
        return materialize(pairs.mapInArrow(run, "id bigint, leader bigint, n int, follows boolean, plus array<bigint>, minus array<bigint>, more int, tok array<bigint>, weight array<bigint>, rest array<bigint>, b0 bigint, b1 bigint"))

    def _entries(self, followers: DataFrame, groups: DataFrame, linked: DataFrame | None) -> DataFrame:
        """The index: leaders and lone sets with their whole prefix, followers with what their leader's lacks.

        linked: (id, component) of sets that are connected already; its entries then bear their component.
        """
        order, share, band = self.order, self.share, self.band
        schema = _ENTRIES if linked is None else f"{_ENTRIES}, component bigint"

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (p for b in batches for p in _portions(b, 2)):
                ident, n, (items, begins) = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _lists(batch.column(2))
                lo, hi, slack, *component = (batch.column(k).to_numpy() for k in range(3, batch.num_columns))
                row, tok, weight, rest = order.value.prefixes(items, begins, share)
                bits = _bitmaps(items, begins)
                yield _entry_batch(tok, weight, ident[row], np.ones(len(row), bool), n[row], lo[row], hi[row], slack[row], rest, bits[:, row], [c[row] for c in component], band)

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                (tok, begins), (weight, _), (rest, _) = (_lists(batch.column(k)) for k in (2, 3, 4))
                row = np.repeat(np.arange(batch.num_rows), np.diff(begins))
                n = batch.column(1).to_numpy()[row]
                bits = np.stack([batch.column(k).to_numpy()[row] for k in (5, 6)])
                component = [batch.column(k).to_numpy()[row] for k in range(7, batch.num_columns)]
                yield _entry_batch(tok, weight, batch.column(0).to_numpy()[row], np.zeros(len(row), bool), n, n, n, np.zeros(len(row), np.int64), rest, bits, component, band)

        # What isn't a lone set: copies and followers drop out, leaders speak for their followers.
        none = F.lit(None).cast("int")
        other = self.members.filter("ord <> rep").select(F.col("ord").alias("id"), F.lit(True).alias("out"), none.alias("lo"), none.alias("hi"), none.alias("slack"))
        other = other.unionByName(followers.select("id", F.lit(True).alias("out"), none.alias("lo"), none.alias("hi"), none.alias("slack")))
        other = materialize(other.unionByName(groups.select(F.col("leader").alias("id"), F.lit(False).alias("out"), "lo", "hi", "slack")))
        lone = self.sets.join(broadcast_if_small(other), "id", "left").filter("out IS NULL OR NOT out")
        lone = lone.select("id", "n", "items", F.least("n", F.coalesce("lo", "n")).alias("lo"), F.greatest("n", F.coalesce("hi", "n")).alias("hi"), F.coalesce("slack", F.lit(0)).alias("slack"))
        probes = followers.select("id", "n", "tok", "weight", "rest", "b0", "b1")
        if linked is not None:
            bear = lambda df: df.join(broadcast_if_small(linked), "id", "left").withColumn("component", F.coalesce("component", "id"))
            lone, probes = bear(lone), bear(probes)
        return lone.mapInArrow(whole, schema).unionByName(probes.mapInArrow(own, schema))

    def answers(self, every: bool = True) -> DataFrame:
        """(a, b), a < b: representatives of different sets that are similar.

        every: all such pairs. Otherwise only links that connect the same sets: sets of one mark are linked with its
        leader where they are similar, and pairs are looked for between the components that come of it.
        """
        rows = self._followers(every)
        followers = rows.filter("follows")
        groups = materialize(followers.groupBy("leader").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("more").alias("slack")))
        first = rows.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
        entries = self._entries(followers, groups, None if every else connected(first))
        met = entries.repartition("list").sortWithinPartitions("list").mapInArrow(_candidates(self.share, self.block), "a bigint, b bigint, wa boolean, wb boolean")
        candidates = met.distinct()
        if every:
            candidates = candidates.unionByName(groups.select(F.col("leader").alias("a"), F.col("leader").alias("b"), F.lit(True).alias("wa"), F.lit(True).alias("wb")))
        candidates = materialize(candidates)

        ids = materialize(candidates.select(F.col("a").alias("id")).unionByName(candidates.select(F.col("b").alias("id"))).distinct())
        left, right = self._of(ids, "a", "ta", "na"), self._of(ids, "b", "tb", "nb")
        slack_of = lambda side, w: groups.select(F.col("leader").alias(side), F.lit(True).alias(w), F.col("lo").alias(f"l{side}"), F.col("slack").alias(f"s{side}"))
        paired = candidates.join(left, "a").join(right, "b").join(slack_of("a", "wa"), ["a", "wa"], "left").join(slack_of("b", "wb"), ["b", "wb"], "left")
        paired = paired.select("a", "b", "ta", "tb", *[F.coalesce(F.least("na", "la") if x == "a" else F.least("nb", "lb"), f"n{x}").alias(f"l{x}") for x in "ab"], *[F.coalesce(f"s{x}", F.lit(-1)).alias(f"s{x}") for x in "ab"])
        seen = materialize(paired.mapInArrow(_verified(self.share, every), _SEEN))

        # Answers of followers, derived from those of their leaders; a leader's own family is its answer, too.
        none = F.array().cast("array<bigint>")
        family = followers.select("leader", F.col("id").alias("f"), F.col("n").alias("fn"), "plus", "minus")
        lead = self._of(groups.select(F.col("leader").alias("id")), "id", "items", "n")
        kin = family.unionByName(lead.select(F.col("id").alias("leader"), F.col("id").alias("f"), F.col("n").alias("fn"), none.alias("plus"), none.alias("minus")))
        todo = seen.filter("again").drop("direct", "again")

        def spread_over(df: DataFrame, on: str, flag: str, p: str) -> DataFrame:
            """Each row once for every set that its side represents: f{p}, fn{p}, plus{p}, minus{p}."""
            names = [F.col("f").alias(f"f{p}"), F.col("fn").alias(f"fn{p}"), F.col("plus").alias(f"plus{p}"), F.col("minus").alias(f"minus{p}")]
            many = df.filter(flag).join(kin.select(F.col("leader").alias(on), *names), on)
            one = df.filter(~F.col(flag)).select("*", F.col(on).alias(f"f{p}"), F.col(f"n{on}").alias(f"fn{p}"), none.alias(f"plus{p}"), none.alias(f"minus{p}"))
            return many.unionByName(one)

        common = lambda x, y: F.size(F.array_intersect(x, y))
        step = spread_over(todo, "a", "ga", "1").withColumn("with_b", F.col("both") - common("minus1", "tb") + common("plus1", "tb"))
        step = spread_over(step, "b", "gb", "2")
        first_with = lambda z: common("ta", z) - common("minus1", z) + common("plus1", z)
        overlap = F.col("with_b") - first_with("minus2") + first_with("plus2")
        derived = step.filter((F.col("f1") != F.col("f2")) & self.similar(overlap, F.col("fn1") + F.col("fn2")))
        found = seen.filter("direct").select("a", "b").unionByName(derived.select(F.least("f1", "f2").alias("a"), F.greatest("f1", "f2").alias("b")))
        return (found if every else found.unionByName(first)).distinct()


def near_duplicate_pairs(df: DataFrame, order: str = "_ord", text: str = "text", similarity: str = SIMILARITY, shingle: int = SHINGLE, least: int = LEAST_WORDS) -> DataFrame:
    """(ord_a, ord_b), ord_a < ord_b: all pairs of records whose sets are similar, equal texts included.

    Records with fewer than ``least`` words, null and blank texts take no part. ``order`` must be unique.
    The number of pairs of a group of equal records is quadratic by definition; near_duplicate_groups
    gives one row per record instead.
    """
    join = SimilarityJoin(shingle_sets(df, order, text, shingle, least), similarity)
    pairs = materialize(join.answers())
    a, b = (join.members.select(F.col("ord").alias(f"ord_{s}"), F.col("rep").alias(s)) for s in "ab")
    across = pairs.join(a, "a").join(b, "b").select("ord_a", "ord_b")
    within = a.join(b, F.col("a") == F.col("b")).filter("ord_a < ord_b").select("ord_a", "ord_b")
    out = across.unionByName(within)
    return out.select(F.least("ord_a", "ord_b").alias("ord_a"), F.greatest("ord_a", "ord_b").alias("ord_b"))


def connected(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the least id that each id is connected with, for pairs (a, b).

    Labels travel along the links and over already found labels (pointer jumping), so the rounds grow
    with the logarithm of the longest path; each round is written to the shared folder.
    """
    links = materialize(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = materialize(links.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("c")).withColumnRenamed("a", "id"))
    for _ in range(most_rounds):
        around = links.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m")).withColumnRenamed("a", "id")
        step = labels.join(around, "id").select("id", F.least("c", "m").alias("n"), "c")
        up = labels.select(F.col("id").alias("n"), F.col("c").alias("up"))
        after = materialize(step.join(up, "n", "left").select("id", F.least("n", F.coalesce("up", "n")).alias("c"), F.col("c").alias("was")))
        labels = after.select("id", "c")
        if after.filter("c <> was").limit(1).count() == 0:
            return labels.select("id", F.col("c").alias("component"))
    raise RuntimeError("the components didn't settle; raise most_rounds")


def near_duplicate_groups(df: DataFrame, order: str = "_ord", text: str = "text", similarity: str = SIMILARITY, shingle: int = SHINGLE, least: int = LEAST_WORDS) -> DataFrame:
    """(ord, representative, group_id, links): one row per record with enough words.

    representative is the least record with the same set, group_id the least record that it is
    connected with by similarity, links the number of links between different sets that hold the group
    together. They are those that connect it, not all pairs: a set near many others is linked with a few.
    """
    join = SimilarityJoin(shingle_sets(df, order, text, shingle, least), similarity)
    pairs = materialize(join.answers(every=False))
    components = connected(pairs)
    links = pairs.select(F.col("a").alias("id")).join(components, "id").groupBy("component").agg(F.count("*").alias("links"))
    rows = join.members.join(components.withColumnRenamed("id", "rep"), "rep", "left").join(links, "component", "left")
    return rows.select("ord", F.col("rep").alias("representative"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
