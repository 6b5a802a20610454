"""Enhanced suffix array of the long repeated suffixes of many byte strings (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

from ticksmith.llm.byte_hashes import gram_hashes
from ticksmith.llm.suffix_words import _groups

#: Bytes compared at once: 9 bits each, 0 beyond a string's end.
STEP = 7


class RepeatedSuffixes:
    """Suffix array and LCPs of the suffixes that can head a left-maximal repeat of ``least`` bytes.

    ``data``: the strings in a row (uint8); ``starts``: where each begins, and
    the total length. Suffixes are first grouped by a hash of their first
    ``least`` bytes. One alone in its group begins no long repeat. A group
    whose suffixes all follow one and the same byte has no left-maximal
    repeat: the group one byte to the left has the same occurrences, and more.
    Only the suffixes of the other groups are sorted, by their bytes, a few at
    a time; ``order`` has their places, ``string`` their strings, ``lcp`` the
    common prefix of each with the one before it.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, least: int) -> None:
        self.least = least
        n = len(data)
        string = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
        end = starts[1:][string] if n else np.zeros(0, np.int64)
        at = np.flatnonzero(np.arange(n) + least <= end)
        order = group = np.zeros(0, np.int64)
        if len(at):
            o, first = _groups(gram_hashes(data, least)[at].view(np.int64))
            at = at[o]
            left = np.where(at == starts[:-1][string[at]], -1, data[at - 1].astype(np.int16))
            cut = np.flatnonzero(first == np.arange(len(first)))
            size = np.diff(np.append(cut, len(at)))
            low, high = np.minimum.reduceat(left, cut), np.maximum.reduceat(left, cut)
            keep = np.repeat((size > 1) & ((low != high) | (low < 0)), size)
            order, group = at[keep], first[keep]
        self.order = order
        self._before = np.where(order == starts[:-1][string[order]], -1, data[np.maximum(order - 1, 0)].astype(np.int64)) \
            if len(order) else np.zeros(0, np.int64)
        self._sort(data, end, group)
        self.string = string[self.order]

    def _keys(self, data: np.ndarray, end: np.ndarray, p: np.ndarray, offset: int) -> np.ndarray:
        """The ``STEP`` bytes from ``offset`` after each place, within its string."""
        key = np.zeros(len(p), np.int64)
        last = end[p] if len(p) else p
        for j in range(offset, offset + STEP):
            i = p + j
            inside = i < last
            key <<= 9
            key |= np.where(inside, data[np.minimum(i, len(data) - 1)].astype(np.int64) + 1, 0)
        return key

    def _sort(self, data: np.ndarray, end: np.ndarray, group: np.ndarray) -> None:
        """Sort within groups, step by step, those that still tie; the LCPs fall out of the steps."""
        p, before = self.order, self._before
        lcp = np.zeros(len(p), np.int64)
        slots = np.arange(len(p))  # places of the tied ones in the order
        tied = group.copy()
        offset = 0
        while len(slots):
            key = self._keys(data, end, p[slots], offset)
            o = np.lexsort((key, tied))
            p[slots], before[slots] = p[slots][o], before[slots][o]
            key = key[o]
            same_group = np.zeros(len(slots), bool)
            same_group[1:] = tied[1:] == tied[:-1]
            a, b = np.append(key[:1], key[:-1]), key
            equal = np.zeros(len(slots), np.int64)
            going = same_group.copy()
            for j in range(STEP - 1, -1, -1):
                x, y = (a >> (9 * j)) & 511, (b >> (9 * j)) & 511
                going &= (x == y) & (x > 0)
                equal += going
            lcp[slots] += equal
            # tie on: the same group, the same full key
            go_on = same_group & (equal == STEP)
            new = np.where(go_on, 0, 1).cumsum()
            alive = go_on.copy()
            alive[:-1] |= go_on[1:]
            # a first of its new group keeps its LCP; the others add to theirs
            slots, tied = slots[alive], new[alive]
            offset += STEP
        self.order, self._before, self.lcp = p, before, lcp

    def maximal_repeats(self, rank: np.ndarray) -> list[tuple[int, int, int]]:
        """(occurrence, length, first occurrence), as numbers into ``order``, of the maximal repeats.

        A stack scan over the LCPs visits each interval when it closes. An
        interval whose occurrences are all preceded by one and the same byte
        is not left-maximal and is passed over. Of the others every
        occurrence but the first (by ``rank``) is listed once, in the longest
        repeat in which it is not the first; the list of a repeat leaves out
        those already in a longer one.
        """
        if not len(self.order):
            return []
        depth = np.where(self.lcp >= self.least, self.lcp, 0).tolist()
        before, when = self._before.tolist(), rank.tolist()
        out: list[tuple[int, int, int]] = []
        stack: list[list] = []  # [depth, left byte or -1, pending members]

        def close(node: list) -> int:
            d, left, members = node
            first = min(members, key=when.__getitem__)
            if left < 0:
                out.extend((e, d, first) for e in members if e != first)
            return first

        def into(node: list, member: int, left: int) -> None:
            node[2].append(member)
            if node[1] != left:
                node[1] = -1

        # the leaf seen last, or the closed interval that holds it: (member, left byte)
        carry = (0, before[0])
        for i in range(len(depth)):
            d = depth[i]
            while stack and stack[-1][0] > d:
                node = stack.pop()
                into(node, *carry)
                carry = (close(node), node[1])
            if d and (not stack or stack[-1][0] < d):
                stack.append([d, carry[1], []])
            if stack:
                into(stack[-1], *carry)
            carry = (i, before[i])
        while stack:
            node = stack.pop()
            into(node, *carry)
            carry = (close(node), node[1])
        return out
