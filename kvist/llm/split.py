"""Splitting of oversized texts at natural boundaries, by agglomerative merging."""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvist.session import union_all

#: Production parameters: the most code points of a piece, and of what it repeats of its predecessor.
LIMIT, OVERLAP = 800, 200

PARAGRAPH, ITEM, LINE, SENTENCE, WORD, INSIDE = 5, 4, 3, 2, 1, 0

# A boundary lies at the end of each match; the alternatives are tried in the order of their strength.
_BREAK = regex.compile(
    r"""(?P<paragraph>(?:\r\n|\n|\r)(?:[^\S\r\n]*(?:\r\n|\n|\r))+)
    |(?P<item>(?:\r\n|\n|\r)(?=[^\S\r\n]*(?:\(\d+\)|[\p{L}\d]{1,3}[).]|[-–•])\s))
    |(?P<line>\r\n|\n|\r)
    |(?P<inline>[.;:]\s+(?=\(\d+\)\s|[a-zæøå]\)\s))
    |(?P<sentence>[.!?…]["»”')\]]*\s+(?=[\p{Lu}\d«"“(]))""",
    regex.VERBOSE,
)
_STRENGTH = {"paragraph": PARAGRAPH, "item": ITEM, "line": LINE, "inline": ITEM, "sentence": SENTENCE}
_WORD = regex.compile(r"\S*\s*")


def segments(text: str, most: int) -> tuple[list[int], list[int]]:
    """(ends, strengths): atomic segments of at most ``most`` code points, and the strength of the boundary at each end.

    Segments end at natural boundaries; one that is too long is taken apart into words, a word that is
    too long into stretches that don't part a letter from its accents.
    """
    ends, strengths, start = [], [], 0
    natural = [(m.end(), _STRENGTH[m.lastgroup]) for m in _BREAK.finditer(text)]
    if not natural or natural[-1][0] < len(text):
        natural.append((len(text), PARAGRAPH))
    for end, strength in natural:
        if end - start > most:
            for m in _WORD.finditer(text, start, end):
                a, b = m.span()
                while b - a > most:
                    cut = a + most
                    while cut > a + 1 and (unicodedata.category(text[cut])[0] == "M" or text[cut] == "‍" or text[cut - 1] == "‍"):
                        cut -= 1
                    ends.append(cut)
                    strengths.append(INSIDE)
                    a = cut
                if b > a:
                    ends.append(b)
                    strengths.append(WORD)
            strengths[-1] = strength
        else:
            ends.append(end)
            strengths.append(strength)
        start = end
    return ends, strengths


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(from, start, end) of each piece: text[start:end] is its own part, text[from:start] repeats its predecessor's end.

    The own parts follow each other without gap, so that they give the whole text. Adjacent segments
    lie in a heap; the weakest boundary goes first (of equal ones the smaller result, then the earlier)
    and its segments are merged if they and the overlap fit into the limit. A text within the limit is
    one piece, an empty one none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    ends, strengths = segments(text, limit - overlap)
    n = len(ends)
    starts = [0, *ends[:-1]]
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
    end_of = ends[:]
    strength_of = strengths[:]
    heap = [(strengths[i], ends[i + 1] - starts[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, i, j = heapq.heappop(heap)
        if gone[i] or gone[j] or after[i] != j or end_of[j] - starts[i] != size:
            continue
        if size + (overlap if starts[i] else 0) > limit:
            continue
        gone[j] = 1
        end_of[i], strength_of[i], after[i] = end_of[j], strength_of[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (strength_of[i], end_of[after[i]] - starts[i], i, after[i]))
        if before[i] >= 0:
            heapq.heappush(heap, (strength_of[before[i]], end_of[i] - starts[before[i]], before[i], i))
    pieces, i, k = [], 0, 0
    while i < n:
        start = starts[i]
        begin = start
        if pieces and overlap:
            low = max(start - overlap, pieces[-1][0])
            begin = _overlap_start(text, low, start)
        pieces.append((begin, start, end_of[i]))
        i, k = after[i], k + 1
    return pieces


def _overlap_start(text: str, low: int, start: int) -> int:
    """The first natural boundary in [low, start), else the first word, else low."""
    if low == 0:
        return 0
    first = next((m.end() for m in _BREAK.finditer(text, low, start) if m.end() < start), None)
    if first is not None:
        return first
    m = regex.compile(r"\s\S").search(text, low - 1, start)
    return m.end() - 1 if m and m.end() - 1 < start else low


def split_fields(df: DataFrame, table_name: str, fields: list[str], limit: int = LIMIT, overlap: int = OVERLAP, order: str = "_ord") -> DataFrame:
    """Pieces of each field value longer than limit.

    (item_table, item_ord, item_field, piece, start, overlap, text): piece counts from 0, start is where
    its own part begins in the value, overlap how much it repeats before that; lengths are code points.
    Null values and those within the limit give nothing. Only oversized values leave the JVM, and each
    is split whole. Repeated rows give repeated pieces. No shuffle.
    """
    long = union_all([
        df.filter(F.length(f) > limit).select(F.lit(table_name).alias("item_table"), F.col(order).cast("long").alias("item_ord"), F.lit(f).alias("item_field"), F.col(f).alias("text"))
        for f in fields
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item_table", "item_ord", "item_field", "piece", "start", "overlap", "text"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [
                    (t, o, f, k, start, start - begin, text[begin:end])
                    for t, o, f, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))
                    for k, (begin, start, end) in enumerate(split(text, limit, overlap))
                ]
                cols = zip(*rows) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return long.mapInArrow(run, "item_table string, item_ord bigint, item_field string, piece int, start int, overlap int, text string")
