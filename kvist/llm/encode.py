"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Speculate and verify: a greedy longest match proposes the tokens of each distinct word, one vectorised
pass tests every adjacent pair of proposed tokens for compatibility, and only the words with an
incompatible pair undergo exact merging. A sequence whose adjacent pairs are all compatible is what
the merges give, as each merge across a border involves only the two tokens beside it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvist.session import spread

#: The folder of the vocabulary files; a parameter everywhere below.
TOKENIZERS = "/opt/tokenizers"

# Fixed value: the pattern that splits text into words before the merges (byte-level BPE, 50k).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct words whose ids a worker keeps; beyond that the store starts anew. Results don't depend on it.
KEPT_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: visible Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class SpeculativeBpe:
    """A byte-level BPE vocabulary whose ids follow its merges' order."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        size = max(vocab.values()) + 1
        to_bytes = lambda t: bytes(letters[c] for c in t)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        base = {t: i for t, i in vocab.items() if len(t) == 1 and t in letters}
        #: Bytes to id, of tokens that the merges can reach.
        self.ids = {to_bytes(t): i for t, i in base.items()}
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        never = np.int64(1) << 40
        self.rank = np.full(size, -1, np.int64)  # when the token is made; bytes are there from the start
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.pairs[i, j] = (r, k)
            if self.rank[k] < 0 and to_bytes(a + b) not in self.ids:
                self.rank[k], left[k], right[k] = r, i, j
                self.ids[to_bytes(a + b)] = k
        keys = np.array([i * size + j for i, j in self.pairs], np.int64)
        order = np.argsort(keys)
        self.size, self.pair_keys = size, keys[order]
        self.pair_ranks = np.array([r for r, _ in self.pairs.values()], np.int64)[order]
        # The pieces at a token's right (left) end in the order in which they arise, and when each is merged on.
        self.right_piece, self.right_end = self._edge(right, never)
        self.left_piece, self.left_end = self._edge(left, never)
        self.longest = max(map(len, self.ids))
        self.words: dict[str, np.ndarray] = {}
        self.failed = self.seen = 0

    def _edge(self, child: np.ndarray, never: int) -> tuple[np.ndarray, np.ndarray]:
        chains = []
        for t in range(self.size):
            c = [t]
            while child[c[-1]] >= 0:
                c.append(int(child[c[-1]]))
            chains.append(c[::-1])
        depth = max(map(len, chains))
        piece, end = np.zeros((self.size, depth), np.int64), np.full((self.size, depth), never, np.int64)
        for t, c in enumerate(chains):
            piece[t, : len(c)] = c
            piece[t, len(c) :] = c[-1]
            end[t, : len(c) - 1] = self.rank[c[1:]]
        return piece, end

    def incompatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of adjacent tokens: would the merges join something across their border?

        The piece that ends at the border and the piece that begins there are followed in time. Where
        their merge comes before the next merge of either, the border doesn't hold. At equal ranks the
        leftmost merge goes first: that within the left token before, that within the right one after.
        """
        broken = np.zeros(len(a), bool)
        live = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        never = np.int64(1) << 40
        while len(live):
            ra, rb = a[live], b[live]
            key = self.right_piece[ra, i[live]] * self.size + self.left_piece[rb, j[live]]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merge = np.where(self.pair_keys[at] == key, self.pair_ranks[at], never)
            ends_a, ends_b = self.right_end[ra, i[live]], self.left_end[rb, j[live]]
            hit = (merge < ends_a) & (merge <= ends_b) & (merge < never)
            broken[live[hit]] = True
            first_a = ends_a <= ends_b
            on = ~hit & (np.minimum(ends_a, ends_b) < never)
            i[live[on & first_a]] += 1
            j[live[on & ~first_a]] += 1
            live = live[on]
        return broken

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, ids = [], 0, len(word), self.ids
        whole = ids.get(word)
        if whole is not None:
            return [whole]
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                t = ids.get(word[at:end])
                if t is not None:
                    out.append(t)
                    at = end
                    break
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals; n log n by a heap over a linked list."""
        from heapq import heapify, heappop, heappush

        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, x, y, k = heappop(heap)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y or ids[i] != x:
                continue
            ids[i], ids[j] = k, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if p := pairs.get((k, ids[after[j]])):
                    heappush(heap, (p[0], i, k, ids[after[j]], p[1]))
            if before[i] >= 0 and (p := pairs.get((ids[before[i]], k))):
                heappush(heap, (p[0], before[i], ids[before[i]], k, p[1]))
        return [t for t in ids if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Put the ids of new words into the store."""
        raw = [w.encode() for w in words]
        tried = [self.propose(w) for w in raw]
        flat = np.fromiter(chain.from_iterable(tried), np.int64)
        owner = np.repeat(np.arange(len(tried)), [len(t) for t in tried])
        inner = owner[1:] == owner[:-1]
        broken = self.incompatible(flat[:-1][inner], flat[1:][inner])
        failing = set(owner[1:][inner][broken].tolist())
        self.seen, self.failed = self.seen + len(words), self.failed + len(failing)
        for k, w in enumerate(words):
            self.words[w] = np.array(self.merge(raw[k]) if k in failing else tried[k], np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts; empty and null texts have no ids."""
        split = [_words(t) if t else [] for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        new = list({w for s in split for w in s if w not in self.words})
        if new:
            self.learn(new)
        get = self.words.__getitem__
        parts = [get(w) for s in split for w in s]
        sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        offsets = ends[np.cumsum([0] + [len(s) for s in split])]
        return offsets, np.concatenate(parts) if parts else np.zeros(0, np.int32)


_words = regex.compile(PATTERN).findall


@lru_cache(maxsize=2)
def vocabulary(path: str) -> SpeculativeBpe:
    """The vocabulary of a file, loaded once in each worker."""
    return SpeculativeBpe(path)


def encode_column(df: DataFrame, id_column: str, text_column: str, vocabulary_name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id_column, ids array<int>): the token ids of each text, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts give an empty list,
    blank texts are encoded as they are, repeated rows give repeated rows, an empty table none. Other
    columns are not read. Surrogates can't occur in Spark's UTF-8. No shuffle: texts are independent.
    """
    path = f"{folder}/{vocabulary_name}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                offsets, ids = bpe.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_column, "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return spread(df.select(F.col(id_column), F.col(text_column)), id_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
