"""Byte-level BPE under a public rank file: splitting, encoding and counting.

Splitting of text into pre-tokens is done for a whole batch of texts at once on arrays of code points.
Encoding merges all new pre-tokens of a batch together with a hierarchical-bitmap rank queue;
counting uses a trie with failure links and emissions computed beforehand.
"""

from __future__ import annotations

import base64
import os
import unicodedata

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: The code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

#: Suffixes that the split pattern takes together with the apostrophe before them, in the order they are tried.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Distinct pre-tokens that a worker remembers before it starts anew; bounds memory, never results.
REMEMBERED = 200_000

#: Code points handled together.
BLOCK_CHARS = 1_000_000


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a vocabulary file: the folder CORPLOOM_TOKENIZERS if set, else /opt/tokenizers."""
    return os.path.join(os.environ.get("CORPLOOM_TOKENIZERS", "/opt/tokenizers"), name)


def read_ranks(path: str | None = None) -> bytes:
    """The bytes of a rank file, to be broadcast; a vocabulary file has a fixed size of about a megabyte."""
    with open(path or default_path(), "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def char_classes() -> np.ndarray:
    """The class (LETTER, NUMBER, SPACE, OTHER) of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = SPACE
    return table


class Splitter:
    """Cuts texts into pre-tokens: contractions, letters, numbers, other characters (each with one space before), white space."""

    def __init__(self, classes: np.ndarray | None = None):
        self.classes = char_classes() if classes is None else classes

    def split(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """All pre-tokens of all texts in order, and for each text the number of pre-tokens before it (one more at the end)."""
        whole = "".join(texts)
        n_texts, n = len(texts), len(whole)
        begin = np.zeros(n_texts + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, n_texts), out=begin[1:])
        if n == 0:
            return [], np.zeros(n_texts + 1, np.int64)
        data = whole.encode("utf-8", "surrogatepass")
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        cls = self.classes[cp]
        first = np.zeros(n, bool)
        first[begin[:-1][begin[:-1] < n]] = True
        start = first.copy()
        start[1:] |= cls[1:] != cls[:-1]
        after = np.flatnonzero((cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~first[1:]) + 1
        start[after - 1] = True
        start[after[cp[after - 1] == 0x20]] = False
        self._contractions(cp, cls, first, start, n)
        at = np.flatnonzero(start)
        counts = np.searchsorted(at, begin)
        if len(data) == n:
            edge = at.tolist()
        else:
            width = np.ones(n, np.int8)
            for limit in (0x80, 0x800, 0x10000):
                width += cp >= limit
            offset = np.cumsum(width, dtype=np.int64) - width
            edge = offset[at].tolist()
        edge.append(len(data))
        return [data[a:b] for a, b in zip(edge, edge[1:])], counts

    @staticmethod
    def _contractions(cp, cls, first, start, n) -> None:
        """Moves the starts around apostrophes at which a contraction is taken."""
        quote = np.flatnonzero(start[:-1] & (cp[:-1] == 0x27) & (cls[1:] == LETTER) & ~first[1:])
        if not len(quote):
            return
        size = np.zeros(len(quote), np.int64)
        for suffix in CONTRACTIONS:
            fits = (size == 0) & (quote + len(suffix) < n)
            for k, ch in enumerate(suffix, 1):
                at = np.minimum(quote + k, n - 1)
                fits &= (cp[at] == ord(ch)) & ~first[at]
            size[fits] = len(suffix)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        end = quote + 1 + size
        start[end[end < n]] = True


class RankQueue:
    """A priority queue of ranks below a bound with buckets of positions.

    Three levels of bitmaps mark the buckets in use; find-first-set at each level leads to the lowest rank.
    Entries are never removed when they become stale: the caller skips them as it takes a bucket.
    """

    BITS = 64

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // self.BITS + 1)
        self.mid = [0] * (len(self.low) // self.BITS + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        """Adds positions to the bucket of a rank; the queue keeps the list if the bucket is new."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        i = rank >> 6
        self.low[i] |= 1 << (rank & 63)
        self.mid[i >> 6] |= 1 << (i & 63)
        self.top |= 1 << (i >> 6)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions in the order they were added; None if the queue is empty."""
        if not self.top:
            return None
        j = (self.top & -self.top).bit_length() - 1
        word = self.mid[j]
        i = (j << 6) + (word & -word).bit_length() - 1
        word = self.low[i]
        bit = word & -word
        rank = (i << 6) + bit.bit_length() - 1
        self.low[i] = word ^ bit
        if not self.low[i]:
            self.mid[j] &= ~(1 << (i & 63))
            if not self.mid[j]:
                self.top &= ~(1 << j)
        return rank, self.buckets.pop(rank)


class Encoder:
    """Exact ids of byte-level BPE: the pair of lowest rank is merged first, the leftmost of equals first."""

    def __init__(self, ranks: dict[bytes, int], splitter: Splitter | None = None):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.bound = max(ranks.values()) + 1
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.splitter = splitter or Splitter()
        self.pairs = self._pairs()
        self.byte_pairs = np.full((256, 256), -1, np.int32)
        for (a, b), r in {(w[0], w[1]): r for w, r in ranks.items() if len(w) == 2}.items():
            self.byte_pairs[a, b] = r
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.ends: list[int] = [0]

    def _pairs(self) -> dict[int, int]:
        """The rank of every merge by the ids of its two parts."""
        find, found = self.ranks.get, {}
        for w, r in self.ranks.items():
            for k in range(1, len(w)):
                if (a := find(w[:k])) is not None and (b := find(w[k:])) is not None:
                    found[(a << 24) | b] = r
        return found

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each non-empty byte string. All strings share one linked list and one queue; no merge crosses their borders."""
        pair = self.pairs.get
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        borders = np.cumsum([0, *map(len, words)])
        ids = np.array(self.byte, np.int64)[data].tolist()
        following = np.arange(1, n + 1)
        following[borders[1:] - 1] = -1
        preceding = np.arange(-1, n - 1)
        preceding[borders[:-1]] = -1
        first = np.full(n, -1, np.int64)
        first[:-1] = self.byte_pairs[data[:-1], data[1:]]
        first[borders[1:] - 1] = -1
        queue = RankQueue(self.bound)
        push = queue.push
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        present, begin = np.unique(first[at], return_index=True)
        for r, positions in zip(present.tolist(), np.split(at, begin[1:])):
            push(r, positions.tolist())
        borders, following, preceding, rank_at = borders.tolist(), following.tolist(), preceding.tolist(), first.tolist()
        while (got := queue.pop()) is not None:
            rank, positions = got
            positions.sort()
            for i in positions:
                if rank_at[i] != rank:
                    continue
                j = following[i]
                ids[i] = rank
                ids[j] = rank_at[j] = -1
                k = following[i] = following[j]
                if k >= 0:
                    preceding[k] = i
                    r = rank_at[i] = pair((rank << 24) | ids[k], -1)
                    if r >= 0:
                        push(r, [i])
                else:
                    rank_at[i] = -1
                h = preceding[i]
                if h >= 0:
                    r = rank_at[h] = pair((ids[h] << 24) | rank, -1)
                    if r >= 0:
                        push(r, [h])
        return [[x for x in ids[s:e] if x >= 0] for s, e in zip(borders, borders[1:])]

    def _learn(self, words: list[bytes]) -> None:
        """Adds words to the remembered encodings."""
        ranks, index, ids, ends = self.ranks, self.index, self.ids, self.ends
        rest = []
        for w in words:
            r = ranks.get(w)
            if r is None:
                rest.append(w)
            else:
                index[w] = len(ends) - 1
                ids.append(r)
                ends.append(len(ids))
        for w, x in zip(rest, self.merge(rest)):
            index[w] = len(ends) - 1
            ids.extend(x)
            ends.append(len(ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (int32), and the offsets of each text in them (one more at the end)."""
        words, counts = self.splitter.split(texts)
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if len(self.index) > REMEMBERED:
            self._forget()
        new = set(words).difference(self.index)
        if new:
            self._learn(sorted(new))
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        flat, ends = np.array(self.ids, np.int32), np.array(self.ends, np.int64)
        size = (ends[1:] - ends[:-1])[which]
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        source = np.arange(total[-1]) + np.repeat(ends[which] - total[:-1], size)
        return flat[source], total[counts]

    def encode_one(self, text: str) -> list[int]:
        """The ids of one text."""
        return self.encode([text])[0].tolist()


def blocks(texts: list[str], limit: int = BLOCK_CHARS):
    """Ranges of texts with about ``limit`` code points each; a longer text makes a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def id_lists(encoder: Encoder, texts: list[str | None]) -> pa.Array:
    """A list<int32> array: the ids of each text, empty for an empty and null for a null text."""
    values, sizes = [], np.zeros(len(texts) + 1, np.int64)
    filled = [t or "" for t in texts]
    for a, b in blocks(filled):
        ids, offsets = encoder.encode(filled[a:b])
        values.append(ids)
        sizes[a + 1 : b + 1] = np.diff(offsets)
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    missing = np.fromiter((t is None for t in texts), bool, len(texts))
    offsets = pa.array(np.cumsum(sizes).astype(np.int32), mask=np.append(missing, False)) if missing.any() else pa.array(np.cumsum(sizes).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
