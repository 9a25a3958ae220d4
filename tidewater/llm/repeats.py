"""Repeats within one chunk of documents: windows, their winnowed anchors and hashes, for words or bytes.

A window of `length` tokens is known by its anchor, the least hash of its runs of `seed` tokens. Equal windows have
equal anchors, so only windows whose anchor stands at two places can be repeats. Everything is derived from the text
alone, the same each time.
"""

from __future__ import annotations

import numpy as np

from tidewater.llm.base import Rolling, mix, sliding

#: Windows of a run at most: in a periodic text one anchor goes on and on. What is hashed at once, a run's tokens, stays
#: below the 1024 that hashes tell apart.
MOST_RUN = 512


class Hashes:
    """Two independent hashes of any range of tokens."""

    def __init__(self, tokens: np.ndarray, others: np.ndarray):
        self.first, self.second = Rolling(tokens, 0), Rolling(others, 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first.of(start, end), self.second.of(start, end)


class Windows:
    """tokens: a 64-bit value each; doc_at: where documents start, and the end. Only the runs of windows are kept."""

    def __init__(self, tokens: np.ndarray, doc_at: np.ndarray, length: int, seed: int):
        n, w = len(tokens), length - seed + 1
        self.length, self.n = length, n
        empty = np.zeros(0, np.int64)
        self.run_start, self.run_size, self.run_anchor, self.anchors = empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        if n < length:
            return
        at = np.arange(n - seed + 1)
        grams = Rolling(tokens, 0).of(at, at + seed)
        least = sliding(grams, w, np.minimum)
        # windows that end beyond their document are none
        whole = np.zeros(len(least) + 1, np.int8)
        first, last = doc_at[:-1], np.maximum(doc_at[1:] - length + 1, doc_at[:-1])
        np.add.at(whole, np.minimum(first, len(least)), 1)
        np.add.at(whole, np.minimum(last, len(least)), -1)
        whole = np.cumsum(whole[:-1]) > 0
        least[~whole] = 0
        pad = np.zeros(w - 1, np.uint64)
        #: hash of each place that is the anchor of a window; least values are small, so they are mixed again to deal evenly
        self.anchors = mix(grams[grams == sliding(np.concatenate([pad, least, pad]), w, np.maximum)])
        # runs of consecutive windows with one anchor
        doc_first = np.zeros(len(least), bool)
        doc_first[doc_at[:-1][doc_at[:-1] < len(least)]] = True
        edge = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]) | doc_first)
        size = np.diff(np.append(edge, len(least)))
        real = whole[edge]
        start, size = edge[real], size[real]
        many = -(-size // MOST_RUN)
        if len(many) and many.max() > 1:
            run = np.repeat(np.arange(len(many)), many)
            skip = MOST_RUN * (np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many))
            start, size = start[run] + skip, np.minimum(size[run] - skip, MOST_RUN)
        self.run_start, self.run_size = start, size
        self.run_anchor = mix(least[self.run_start])

    def windows(self, runs: np.ndarray) -> np.ndarray:
        """Starts of the windows of the chosen runs."""
        size = self.run_size[runs]
        return np.repeat(self.run_start[runs] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Mask of the tokens that the windows at `starts` cover."""
        delta = np.zeros(self.n + 1, np.int32)
        np.add.at(delta, starts, 1)
        np.add.at(delta, starts + self.length, -1)
        return np.cumsum(delta[:-1]) > 0
