"""An FM-index over integer symbols: suffix order, and rank over a wavelet matrix of packed bits, for many searches at once."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` symbols (by prefix doubling); ties stay in place."""
    n = len(text)
    rank, k = text.astype(np.int64), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        if k < n:
            after[:-k] = rank[k:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.zeros(n, dtype=np.int64)
        new[order[1:]] = np.cumsum(key[1:] != key[:-1])
        rank, k = new, 2 * k
        if k >= depth or (n and rank[order[-1]] == n - 1):
            return order


class FMIndex:
    """Counts of patterns up to ``depth`` long, by backward search of many patterns in step.

    The Burrows-Wheeler transform is kept as a wavelet matrix: for each bit of the symbols, 64 bits a word, and the
    number of ones before each word.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        n = self.n = len(text)
        order = suffix_order(text, depth)
        row = text[order - 1]  # the symbol before each suffix; the text is a circle, of which no pattern takes the seam
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((row >> level) & 1).astype(np.uint8)
            packed = np.zeros((n // 64 + 1) * 8, dtype=np.uint8)
            bits = np.packbits(bit, bitorder="little")
            packed[: len(bits)] = bits
            words = packed.view("<u8")
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int32), dtype=np.int32)])[:-1].astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        start = np.zeros(symbols + 1, dtype=np.int64)
        start[1:] = np.cumsum(np.bincount(text, minlength=symbols))
        self.first = start[:-1]
        self.origin = self._down(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            at = i >> 6
            ones = self.before[k][at] + np.bitwise_count(self.words[k][at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((c >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of patterns, each with the symbol c put before it."""
        both = self._down(np.concatenate([c, c]), np.concatenate([lo, hi])).reshape(2, -1) + (self.first - self.origin)[c]
        return both[0], both[1]


def reach(index: FMIndex, text: np.ndarray, at: np.ndarray, stop: np.ndarray, step: int, least: int = 2) -> np.ndarray:
    """Matching statistics: how far from ``at`` each search goes, in direction ``step``, while its pattern occurs ``least`` times.

    Returns the first position not taken; never beyond ``stop`` (which is not taken either).
    """
    at = at.copy()
    on = np.flatnonzero(at != stop)
    lo, hi = np.zeros(len(on), np.int64), np.full(len(on), index.n, np.int64)
    while len(on):
        lo, hi = index.step(text[at[on]], lo, hi)
        good = hi - lo >= least
        on, lo, hi = on[good], lo[good], hi[good]
        at[on] += step
        good = at[on] != stop[on]
        on, lo, hi = on[good], lo[good], hi[good]
    return at


def repeated_spans(texts: list[list], window: int) -> list[tuple[int, int, int]]:
    """(text, start, end): the longest spans of at least ``window`` symbols that occur elsewhere too.

    texts are lists of hashable symbols; a text that occurs twice in the list is repeated itself. A symbol that
    occurs once is in no repeated span, so texts are first cut there and their short rests dropped.
    Searches then run over all texts in step: backward from the right end to the first symbol with
    which the span is unique, then forward from that symbol to find the next right end.
    """
    ids: dict = {}
    text = np.array([ids.setdefault(w, len(ids) + 1) for t in texts for w in t], dtype=np.int64)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    place = np.repeat(np.arange(len(texts)), length)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(length) - length, length)
    for _ in range(3):
        if not len(text):
            return []
        often = np.bincount(text)[text] > 1
        # runs of such symbols, in one text and without gaps
        joined = np.zeros(len(text), dtype=bool)
        joined[1:] = often[1:] & often[:-1] & (place[1:] == place[:-1]) & (offset[1:] == offset[:-1] + 1)
        run = np.cumsum(~joined)
        keep = often & (np.bincount(run)[run] >= window)
        text, place, offset, run = text[keep], place[keep], offset[keep], run[keep]
    if not len(text):
        return []
    text = np.unique(text, return_inverse=True)[1] + 1
    joined = np.zeros(len(text), dtype=bool)
    joined[1:] = run[1:] == run[:-1]
    first = np.flatnonzero(~joined)
    # one symbol, which no search takes, ends every run
    spread = np.arange(len(text)) + np.cumsum(~joined) - 1
    flat = np.zeros(len(text) + len(first), dtype=np.int64)
    flat[spread] = text
    starts, ends = spread[first], np.append(spread[first[1:]] - 1, len(flat) - 1)
    symbols = int(text.max()) + 1
    back, forth = FMIndex(flat, symbols, int((ends - starts).max()) + 1), FMIndex(flat[::-1], symbols, int((ends - starts).max()) + 1)
    out, on, right = [], np.arange(len(starts)), ends.copy()
    owner, shift = place[first], offset[first] - starts
    while len(on := on[right[on] - starts[on] >= window]):
        left = reach(back, flat, right[on] - 1, starts[on] - 1, -1) + 1
        long = right[on] - left >= window
        some = on[long]
        out += zip(owner[some].tolist(), (left[long] + shift[some]).tolist(), (right[some] + shift[some]).tolist())
        more = left > starts[on]
        on, left = on[more], left[more]
        if len(on):
            right[on] = reach(forth, flat, left - 1, right[on], 1)
    return out
