"""A compressed FM-index over word sequences, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text`` (small non-negative numbers; the end sorts first), by doubling."""
    n = len(text)
    rank, step = text.astype(np.int64) + 1, 1
    top = int(rank.max(initial=0)) + 1
    while True:
        # as many ranks in one key as fit
        key, width = rank.copy(), 1
        while width < 4 and top ** (width + 1) < 1 << 62 and (step == 1 or width < 2):
            later = np.zeros(n, np.int64)
            if step * width < n:
                later[: n - step * width] = rank[step * width :]
            key = key * top + later
            width += 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]])) if n else []
        rank, step = new, step * width
        if n == 0 or rank[order[-1]] == n:
            return order
        top = n + 1


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit vector with block counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        n = len(symbols)
        at = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (at >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + -n % 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(n - int(bit.sum()))
            at = np.concatenate([at[bit == 0], at[bit == 1]])
        # where the occurrences of each symbol start on the last level
        self.base = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (words, counts, zeros) in enumerate(zip(self.words, self.counts, self.zeros)):
            block = at >> 6
            below = words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[block] + np.bitwise_count(below)
            at = np.where(symbol >> (self.levels - 1 - level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.base[symbol]


class FMIndex:
    """Backward search over the concatenation of ``parts``, each closed by symbol 0; symbols are 1 and up."""

    def __init__(self, symbols: np.ndarray, size: int):
        order = suffix_array(symbols)
        self.n, self.size = len(symbols), size
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))]).astype(np.int64)
        self.bwt = WaveletMatrix(symbols[order - 1], size)

    def first(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of one symbol."""
        return self.starts[symbol], self.starts[symbol + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with a symbol put in front."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.starts[symbol]
        return start + both[: len(symbol)], start + both[len(symbol) :]


def repeated_windows(words: np.ndarray, sizes: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """For distinct segments (concatenated ``words``, ``sizes`` each, ``copies`` in the corpus): which windows of ``length``
    words occur twice or more in all segments, a bit for each start (64 at most).

    Matching statistics by backward search, all segments in step: a match is extended to the left while it
    occurs twice; where it stops, windows over the stop are out, and one search from the first window's end
    to the stop mostly shows that no window is left.
    """
    n = len(sizes)
    mask = np.zeros(n, np.uint64)
    values, dense = np.unique(words, return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    text = np.zeros(len(words) + n, np.int64)
    text[np.arange(len(words)) + np.repeat(np.arange(n), sizes)] = dense + 1
    index = FMIndex(text, len(values) + 1)
    symbol = dense + 1
    # one row for each segment under way: its end, left border, interval, the stop that is probed and the end before it
    seg = np.flatnonzero(sizes >= length)
    end, left = ends[seg], ends[seg]
    low, high = np.zeros(len(seg), np.int64), np.full(len(seg), index.n)
    stop, resume = np.full(len(seg), -1), np.full(len(seg), -1)
    probed = np.full(len(seg), -1)
    while len(seg):
        s = symbol[left - 1]
        fresh = left == end
        lo, hi = index.starts[s], index.starts[s + 1]
        old = np.flatnonzero(~fresh)
        if len(old):
            lo[old], hi[old] = index.extend(s[old], low[old], high[old])
        ok = (hi - lo >= 2) | ((copies[seg] >= 2) & (hi > lo))
        left = np.where(ok, left - 1, left)
        low, high = np.where(ok, lo, low), np.where(ok, hi, high)
        begin = starts[seg]
        probing = stop >= 0
        over = np.where(probing, ~ok | (left <= stop), ~ok | (left == begin))
        if not over.any():
            continue
        # matches found: windows from left up to end - length
        found = over & ~probing & (end - left >= length)
        for k in np.flatnonzero(found):
            a, b = int(left[k] - begin[k]), int(end[k] - length - begin[k])
            mask[seg[k]] |= np.uint64(((1 << (b - a + 1)) - 1) << a)
        first = begin + length
        done = over & np.where(probing, ~ok, ~ok & (np.minimum(end - 1, left + length - 1) < first) | (left == begin))
        go = over & ~done
        # a probe that reached its stop: ends are tried one by one from where it was left
        back = go & probing
        end = np.where(back, resume, end)
        probed = np.where(back, stop, probed)
        stop = np.where(back, -1, stop)
        # a match that stopped: the next end below, after a probe from the first window's end
        halt = go & ~probing
        nxt = np.minimum(end - 1, left + length - 1)
        probe = halt & (left - 1 < first) & (probed != left - 1) & (nxt > first)
        resume = np.where(probe, nxt, resume)
        stop = np.where(probe, left - 1, stop)
        end = np.where(probe, first, np.where(halt, nxt, end))
        left = np.where(go, end, left)
        low, high = np.where(go, 0, low), np.where(go, index.n, high)
        keep = ~done
        seg, end, left, low, high, stop, resume, probed = (x[keep] for x in (seg, end, left, low, high, stop, resume, probed))
    return mask
