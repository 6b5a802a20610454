"""Suffix arrays over the words of many texts at once (numpy, inside tasks).

The symbols are the words ``[^\\x20\\x09-\\x0D]+``. Suffixes of different
texts never compare equal, so one sort serves a whole chunk of texts.
"""

from __future__ import annotations

import numpy as np


def word_ids(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row, and where each text starts (one more at the end)."""
    vocab: dict[bytes, int] = {}
    put = vocab.setdefault
    ids: list[int] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            # bytes.split() parts at exactly the six ASCII blanks
            ids += [put(w, len(vocab)) for w in t.encode("utf-8", "replace").split()]
        starts[i + 1] = len(ids)
    return np.array(ids, np.int64), starts


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order of ``keys``, and for each sorted place the first place of its key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.empty(len(k), bool)
    new[:1] = True
    np.not_equal(k[1:], k[:-1], out=new[1:])
    first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    return order, first


class WordSuffixes:
    """Suffix array by prefix doubling; only suffixes that still tie are sorted again."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray) -> None:
        n = len(ids)
        self.n, self.ids, self.starts = n, ids, starts
        self.text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.end = starts[1:][self.text_of] if n else np.zeros(0, np.int64)
        at = np.arange(n)
        nxt = np.zeros(n, np.int64)
        if n > 1:
            nxt[:-1] = ids[1:] + 1
        nxt[at + 1 >= self.end] = 0
        v = int(ids.max()) + 2 if n else 2
        texts = len(starts)
        if texts * v * v < 2**62:
            key = (self.text_of * v + ids) * v + nxt
        else:  # a very large vocabulary: rank the first words beforehand
            order, first = _groups(self.text_of * v + ids)
            one = np.empty(n, np.int64)
            one[order] = first
            key = one * v + nxt
        order, first = _groups(key)
        rank = np.empty(n, np.int64)
        rank[order] = first
        #: rank[i] by the first 2, 4, 8, ... words; equal ranks = equal words
        self.levels = [rank]
        self.order = order
        self._tied = order[self._ties(first)]

    @staticmethod
    def _ties(first: np.ndarray) -> np.ndarray:
        n = len(first)
        tie = np.zeros(n, bool)
        if n > 1:
            same = first[1:] == first[:-1]
            tie[1:] |= same
            tie[:-1] |= same
        return tie

    def repeated_windows3(self) -> np.ndarray:
        """For each word: is it in a 3-word window that its text holds twice or more?"""
        hit = np.zeros(self.n + 2, bool)
        p = self._tied[self._tied + 2 < self.end[self._tied]]
        if len(p):
            order, first = _groups(self.levels[0][p] * (int(self.ids.max()) + 2) + self.ids[p + 2])
            q = p[order[self._ties(first)]]
            for d in range(3):
                hit[q + d] = True
        return hit[: self.n]

    def finish(self) -> None:
        """Double the compared length until no two suffixes tie."""
        tied, h = self._tied, 2
        rank = self.levels[0]
        while len(tied):
            after = tied + h
            nxt = np.where(after < self.end[tied], rank[np.minimum(after, self.n - 1)] + 1, 0)
            order, first = _groups(rank[tied] * (self.n + 1) + nxt)
            rank = rank.copy()
            p = tied[order]
            # place in the whole array = start of the old group + place within it
            old = self.levels[-1][p]
            within = np.arange(len(p)) - _first_of(old)
            new = np.maximum.accumulate(np.where(first == np.arange(len(p)), old + within, 0))
            rank[p] = new
            self.levels.append(rank)
            self.order[old + within] = p
            tied = p[self._ties(first)]
            h *= 2

    def lcp(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours in the suffix array with at least ``least`` common words: left, right, length."""
        a, b = self.order[:-1], self.order[1:]
        top = 0
        while top + 1 < len(self.levels) and 2 ** (top + 2) <= least:
            top += 1
        if 2 ** (top + 1) <= least:
            keep = self.levels[top][a] == self.levels[top][b]
            a, b = a[keep], b[keep]
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            r, h = self.levels[k], 2 ** (k + 1)
            x, y = a + n, b + n
            ok = (x < self.end[a]) & (y < self.end[b])
            ok[ok] = r[x[ok]] == r[y[ok]]
            n[ok] += h
        x, y = a + n, b + n
        ok = (x < self.end[a]) & (y < self.end[b])
        ok[ok] = self.ids[x[ok]] == self.ids[y[ok]]
        n[ok] += 1
        keep = n >= least
        return a[keep], b[keep], n[keep]


def _first_of(sorted_values: np.ndarray) -> np.ndarray:
    """For each place, the first place with the same value (values are in runs)."""
    n = len(sorted_values)
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))
