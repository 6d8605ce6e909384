"""Token counts in linear time from a trie with failure links and emissions computed beforehand.

LongestMatch counts for longest-match vocabularies: each state carries how many tokens its failure link emits.
MergeCounter counts for byte-pair vocabularies, whose results are not longest matches: each state carries the
tokens that end there, longest first, and the first one that may follow the token before it is the last token
of the prefix, so one pass over the bytes gives the exact number.
"""

from __future__ import annotations

import numpy as np

from .bpe import REMEMBERED, Splitter


class Trie:
    """Byte strings as states; ``step`` has the children, ``fail`` the longest proper suffix that is a state."""

    def __init__(self, tokens: list[bytes]):
        step: dict[int, int] = {}
        self.depth, self.ends, self.last, parent = [0], [-1], [0], [0]
        for number, token in enumerate(tokens):
            at = 0
            for b in token:
                key = (at << 8) | b
                to = step.get(key)
                if to is None:
                    to = step[key] = len(self.depth)
                    self.depth.append(self.depth[at] + 1)
                    self.ends.append(-1)
                    self.last.append(b)
                    parent.append(at)
                at = to
            self.ends[at] = number
        self.step, self.parent = step, parent
        self.order = sorted(range(1, len(parent)), key=self.depth.__getitem__)
        self.fail = [0] * len(parent)
        for v in self.order:
            if self.depth[v] > 1:
                f, b = self.fail[parent[v]], self.last[v]
                while (to := step.get((f << 8) | b)) is None and f:
                    f = self.fail[f]
                self.fail[v] = to or 0


class Words:
    """Counts of texts from those of their pre-tokens, which are remembered. Subclasses have splitter, known, whole and count()."""

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        words, begin = self.splitter.split(texts)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, whole = self.known, self.whole
        for w in set(words).difference(known):
            known[w] = 1 if w in whole else self.count(w)
        total = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), out=total[1:])
        return np.diff(total[begin])


class LongestMatch:
    """Counts of tokens when the longest token of the vocabulary is taken at each place.

    The vocabulary must hold every single byte of the texts; a byte that is in no token counts as one token.
    """

    def __init__(self, tokens: list[bytes]):
        self.trie = trie = Trie(tokens)
        n = len(trie.parent)
        #: What is left when the longest token at the front is cut off (and again until a state is left), and how many were cut.
        self.link, self.emitted = [-1] * n, [0] * n
        step = trie.step
        for v in trie.order:
            if trie.ends[v] >= 0:
                self.link[v], self.emitted[v] = 0, 1
                continue
            u, b = trie.parent[v], trie.last[v]
            z, count = self.link[u], self.emitted[u]
            while z > 0 and (z << 8) | b not in step:
                count += self.emitted[z]
                z = self.link[z]
            if z >= 0 and (to := step.get((z << 8) | b)) is not None:
                self.link[v], self.emitted[v] = to, count

    def count(self, data: bytes) -> int:
        """The number of tokens of one byte string."""
        step, link, emitted = self.trie.step, self.link, self.emitted
        at = total = 0
        for b in data:
            while (to := step.get((at << 8) | b)) is None and at:
                if link[at] < 0:  # no token begins here: its first byte counts alone
                    return self._plain(data)
                total += emitted[at]
                at = link[at]
            if to is None:
                total += 1
                at = 0
            else:
                at = to
        while at:
            if link[at] < 0:
                return self._plain(data)
            total += emitted[at]
            at = link[at]
        return total

    def _plain(self, data: bytes) -> int:
        step, ends = self.trie.step, self.trie.ends
        i = total = 0
        while i < len(data):
            at, best = 0, 1
            for j in range(i, len(data)):
                at = step.get((at << 8) | data[j], 0)
                if not at:
                    break
                if ends[at] >= 0:
                    best = j - i + 1
            i += best
            total += 1
        return total


class LongestCounter(Words):
    """Counts of texts for a longest-match vocabulary, pre-token by pre-token."""

    def __init__(self, ranks: dict[bytes, int], splitter: Splitter | None = None):
        self.splitter, self.known, self.whole = splitter or Splitter(), {}, ranks
        self.count = LongestMatch(sorted(ranks, key=ranks.get)).count


def derivations(ranks: dict[bytes, int]) -> np.ndarray:
    """For each id the two ids of its last merge; a single byte has itself twice."""
    parts = np.zeros((max(ranks.values()) + 1, 2), np.int32)
    for w, r in ranks.items():
        if len(w) == 1:
            parts[r] = r
            continue
        cuts = [k for k in range(1, len(w)) if ranks.get(w[:k], r) < r and ranks.get(w[k:], r) < r]
        if len(cuts) == 1:
            k = cuts[0]
            parts[r] = ranks[w[:k]], ranks[w[k:]]
            continue
        seq = [w[i : i + 1] for i in range(len(w))]
        while len(seq) > 2:
            best, i = min((ranks.get(a + b, r), i) for i, (a, b) in enumerate(zip(seq, seq[1:])))
            if best >= r:
                break
            seq[i : i + 2] = [seq[i] + seq[i + 1]]
        if len(seq) == 2:
            parts[r] = ranks[seq[0]], ranks[seq[1]]
        else:
            parts[r] = r
    return parts


class MergeCounter(Words):
    """Exact token counts of byte-level BPE without the token sequence being built."""

    def __init__(self, ranks: dict[bytes, int], parts: np.ndarray | None = None, splitter: Splitter | None = None):
        parts = derivations(ranks) if parts is None else parts
        self.left, self.right = parts[:, 0].tolist(), parts[:, 1].tolist()
        self.splitter = splitter or Splitter()
        tokens = sorted(ranks, key=ranks.get)
        rank = [ranks[t] for t in tokens]
        self.trie = trie = Trie(tokens)
        self.joins = {}
        for w, r in ranks.items():
            for k in range(1, len(w)):
                if (a := ranks.get(w[:k])) is not None and (b := ranks.get(w[k:])) is not None:
                    self.joins[(a << 24) | b] = r
        self.ending: list[tuple] = [()] * len(trie.parent)
        for v in trie.order:
            rest = self.ending[trie.fail[v]]
            self.ending[v] = ((rank[trie.ends[v]], trie.depth[v]), *rest) if trie.ends[v] >= 0 else rest
        self.follows: dict[int, bool] = {}
        self.known: dict[bytes, int] = {}
        self.whole = ranks

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether ids a, b stay apart: at no time during their making does a pair across the border merge first."""
        before = 1 << 62
        while True:
            r = self.joins.get((a << 24) | b, before)
            if r < before:
                return False
            # undo the later of the two makings; what is beside the border then could have merged before it
            x, y = self.right[a], self.left[b]
            if a > b and x != a:
                before, a = a, x
            elif y != b:
                before, b = b + 1, y
            elif x != a:
                before, a = a, x
            else:
                return True

    def count(self, word: bytes) -> int:
        """The number of tokens of one pre-token."""
        step, fail, ending, follows = self.trie.step, self.trie.fail, self.ending, self.follows
        last, count = [-1], [0]
        at = 0
        for i, b in enumerate(word, 1):
            while (to := step.get((at << 8) | b)) is None and at:
                at = fail[at]
            at = to or 0
            for token, size in ending[at]:
                before = last[i - size]
                if before >= 0:
                    key = (before << 24) | token
                    ok = follows.get(key)
                    if ok is None:
                        if len(follows) > 4 * REMEMBERED:
                            follows.clear()
                        ok = follows[key] = self._may_follow(before, token)
                    if not ok:
                        continue
                last.append(token)
                count.append(count[i - size] + 1)
                break
        return count[-1]
