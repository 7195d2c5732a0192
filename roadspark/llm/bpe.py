"""Byte-pair merging of many words at once.

Words lie one after another in flat numpy arrays. Each round finds, in every word, the pair of neighbours with the
lowest rank, merges all its leftmost, non-overlapping places in that word at once and closes the gaps, until no word
has a pair left. A word whose pair might open a better pair by being merged (possible when a vocabulary string has
several splits) merges only its leftmost place in that round, which is what a merge by merge loop would do.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(1 << 40)


class MergeTable:
    """Pairs (left id, right id) -> rank and merged id, looked up by binary search in one sorted array."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.merged = key[order], rank.astype(np.int64)[order], merged.astype(np.int64)[order]
        best = {}
        for a, b, r in zip(left.tolist(), right.tolist(), rank.tolist(), strict=True):
            for part in (a, b):
                if r < best.get(part, NONE):
                    best[part] = r
        # merging into m is unsafe if m is part of a pair that ranks before m's own pair
        self.unsafe = np.array([best.get(m, NONE) < r for m, r in zip(self.merged.tolist(), self.rank.tolist(), strict=True)], dtype=bool)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the table, or -1."""
        key = (left << 32) | right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, at, -1)


def merge_words(symbols: np.ndarray, starts: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """symbols: ids of all words; starts: where each (non-empty) word begins. Returns both after all merges.

    Words that are done leave the working arrays, so late rounds touch only the words that still merge.
    """
    n = len(starts)
    lengths = np.diff(np.append(starts, len(symbols)))
    done_sym: list[np.ndarray] = []
    done_word: list[np.ndarray] = []
    word = np.repeat(np.arange(n, dtype=np.int64), lengths)
    sym = symbols.astype(np.int64)
    while len(sym):
        same = np.zeros(len(sym), dtype=bool)
        same[:-1] = word[1:] == word[:-1]
        at = np.full(len(sym), -1, dtype=np.int64)
        i = np.flatnonzero(same)
        at[i] = table.find(sym[i], sym[i + 1])
        rank = np.where(at >= 0, table.rank[at], NONE)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, first)
        counts = np.diff(np.append(first, len(sym)))
        live = np.repeat(least < NONE, counts)
        if not live.all():
            done_sym.append(sym[~live])
            done_word.append(word[~live])
        hit = live & (rank == np.repeat(least, counts))
        # within a run of overlapping hits every second one, from the left
        j = np.flatnonzero(hit)
        if len(j) == 0:
            break
        run_start = np.append(True, (np.diff(j) != 1) | (word[j[1:]] != word[j[:-1]]))
        run_first = np.maximum.accumulate(np.where(run_start, j, 0))
        j = j[(j - run_first) % 2 == 0]
        if table.unsafe[at[j]].any():
            w = word[j]
            leftmost = np.append(True, w[1:] != w[:-1])
            j = j[leftmost | ~table.unsafe[at[j]]]
        sym[j] = table.merged[at[j]]
        keep = live
        keep[j + 1] = False
        sym, word = sym[keep], word[keep]
    if not done_sym:
        return np.empty(0, np.int64), np.zeros(n, np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    sym, word = sym[order], word[order]
    return sym, np.searchsorted(word, np.arange(n))
