"""A compressed FM-index of many short sequences: suffix array by prefix doubling, wavelet matrix over the BWT.

The index keeps the wavelet matrix (one bit per symbol and level, with counts), the LCP array and, for a threshold
L, the classes of suffixes that share their first L symbols. Queries are streamed through it right to left, all in
step: each step extends every query's match by one symbol with backward search, or shortens it from the right, by the
parent interval, until it can be extended. That gives the matching statistics of each query at each place.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank(c, i): how often c stands before place i."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        s = symbols.astype(np.uint32)
        for b in range(self.bits - 1, -1, -1):
            bit = (s >> np.uint32(b)) & np.uint32(1)
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
            ones = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.words.append(packed)
            self.counts.append(ones.astype(np.uint32))
            self.zeros.append(int(len(s) - ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        every = np.arange(n_symbols)
        self.first = np.zeros(n_symbols, np.int64)
        self.first = self._down(every, np.zeros(n_symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            words, counts = self.words[level], self.counts[level]
            w = i >> 6
            below = words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[w].astype(np.int64) + np.bitwise_count(below)
            up = (c >> (self.bits - 1 - level)) & 1
            i = np.where(up == 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(c, i) - self.first[c]


class FMIndex:
    """Of sequences of symbols (any unsigned 64-bit numbers), with a label for each sequence.

    sequences: all symbols in a row; bounds: where each sequence begins, and the end; threshold: L."""

    def __init__(self, sequences: np.ndarray, bounds: np.ndarray, labels: np.ndarray, threshold: int):
        self.threshold = threshold
        self.alphabet, codes = np.unique(sequences, return_inverse=True)
        lengths = np.diff(bounds)
        n_seq, n = len(lengths), len(sequences) + len(lengths)
        # each sequence ends with a separator of its own; in the BWT all separators are symbol 0
        of = np.repeat(np.arange(n_seq), lengths + 1)
        text = np.zeros(n, np.int64)
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = codes + 1
        rank = np.where(inside, text + n_seq - 1, of)
        ladder = [(1, self._dense(rank))]
        width, longest = 1, int(lengths.max(initial=0)) + 1
        while width < longest:
            rank = ladder[-1][1]
            right = np.zeros(n, np.int64)
            right[: n - width] = rank[width:] + 1
            ladder.append((2 * width, self._dense(rank * (n + 1) + right)))
            width *= 2
        sa = np.empty(n, np.int64)
        sa[ladder[-1][1]] = np.arange(n)
        bwt = text[sa - 1]  # sa - 1 is -1 for the first place: the last separator
        n_symbols = len(self.alphabet) + 1
        self.wavelet = WaveletMatrix(bwt, n_symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.n = n
        self.lcp = self._lcp(ladder, sa, n)
        first = np.ones(n, bool)
        first[1:] = self.lcp[1:n] < threshold
        self.class_of = np.cumsum(first) - 1
        self.class_label = np.minimum.reduceat(labels[of[sa]], np.flatnonzero(first)) if n else labels[:0]

    @staticmethod
    def _dense(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        new = np.ones(len(key), np.int64)
        new[0:1] = 0
        new[1:] = key[order][1:] != key[order][:-1]
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(new)
        return out

    @staticmethod
    def _lcp(ladder: list[tuple[int, np.ndarray]], sa: np.ndarray, n: int) -> np.ndarray:
        """Common symbols of neighbours in the suffix array, by the ranks of their prefixes; -1 at both ends."""
        a, b = sa[:-1].copy(), sa[1:].copy()
        out = np.zeros(n + 1, np.int64)
        out[0] = out[n] = -1
        for width, rank in reversed(ladder):
            ok = (a < n) & (b < n)
            same = np.zeros(len(a), bool)
            same[ok] = rank[a[ok]] == rank[b[ok]]
            out[1:n][same] += width
            a[same] += width
            b[same] += width
        return out

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Codes of symbols; 0 for those that the index doesn't hold."""
        if not len(self.alphabet):
            return np.zeros(len(symbols), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at + 1, 0)

    def matching_statistics(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of each query: how many symbols from there on, within the query, stand in the index, and a
        place of the suffix array where they begin."""
        code = self.codes(symbols)
        length, place = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        starts, ends = bounds[:-1], bounds[1:]
        order = np.argsort(starts - ends, kind="stable")  # longest first: those still running are a prefix
        starts, ends = starts[order], ends[order]
        low, high, depth = np.zeros(len(order), np.int64), np.full(len(order), self.n), np.zeros(len(order), np.int64)
        spans = ends - starts
        for t in range(int(spans.max(initial=0))):
            k = int(np.searchsorted(-spans, -t, "left"))
            at = ends[:k] - 1 - t
            c = code[at]
            todo = np.arange(k)
            while len(todo):
                x = c[todo]
                base = self.before[x]
                a = base + self.wavelet.rank(x, low[todo])
                b = base + self.wavelet.rank(x, high[todo])
                good = (a < b) & (x > 0)
                won = todo[good]
                low[won], high[won] = a[good], b[good]
                depth[won] += 1
                lost = todo[~good]
                ended = (depth[lost] == 0) | (c[lost] == 0)
                none = lost[ended]
                low[none], high[none], depth[none] = 0, self.n, 0
                todo = lost[~ended]
                if len(todo):
                    self._parent(todo, low, high, depth)
            length[at], place[at] = depth[:k], low[:k]
        return length, place

    def _parent(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> None:
        """Widens each row's interval to the next shorter prefix that more suffixes share."""
        lo, hi = low[rows], high[rows]
        d = np.maximum(np.maximum(self.lcp[lo], self.lcp[hi]), 0)
        while (m := (self.lcp[lo] >= d) & (lo > 0)).any():
            lo[m] -= 1
        while (m := (self.lcp[hi] >= d) & (hi < self.n)).any():
            hi[m] += 1
        low[rows], high[rows], depth[rows] = lo, hi, d

    def least_label(self, length: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For places with a match of L symbols at least: the least label of a sequence that holds those L; else the
        largest number there is."""
        out = np.full(len(length), np.iinfo(np.int64).max)
        long_ = length >= self.threshold
        out[long_] = self.class_label[self.class_of[place[long_]]]
        return out
