"""Compressed FM-index over word ids: wavelet matrix, capped common lengths, a sampled suffix array; matching
statistics by backward search for many texts at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with counts before each word; rank by population count."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class Wavelet:
    """Wavelet matrix: rank of any symbol in one bit-vector rank per bit of the alphabet."""

    def __init__(self, text: np.ndarray, bits: int):
        self.levels: list[tuple[Bits, int]] = []
        for b in reversed(range(bits)):
            own = ((text >> b) & 1).astype(np.uint8)
            zeros = int(len(own) - own.sum())
            self.levels.append((Bits(own), zeros))
            text = np.concatenate([text[own == 0], text[own == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before place i."""
        lo = np.zeros_like(i)
        for k, (bits, zeros) in enumerate(self.levels):
            one = ((symbol >> (len(self.levels) - 1 - k)) & 1).astype(bool)
            r_lo, r_i = bits.rank(lo), bits.rank(i)
            lo = np.where(one, zeros + r_lo, lo - r_lo)
            i = np.where(one, zeros + r_i, i - r_i)
        return i - lo


class FMIndex:
    """Index over a text of word ids from 1; 0 separates documents and is in no query. Searches go up to most words.

    It keeps the wavelet matrix (a bit a word and level), the common length of neighbours in suffix order up to most
    (a byte a word), and the suffix array sampled once for every interval of most words: the earliest of its places.
    Suffix array and ranks are only needed while it is built.
    """

    def __init__(self, text: np.ndarray, most: int):
        n = self.n = len(text)
        self.most = most
        ranks = {1: np.unique(text, return_inverse=True)[1].astype(np.int64) + 1}
        k = 1
        while k <= most:
            ahead = np.zeros(n, np.int64)
            if k < n:
                ahead[: n - k] = ranks[k][k:]
            ranks[2 * k] = np.unique(ranks[k] * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
            k *= 2
        sa = np.argsort(ranks.pop(k), kind="stable")
        sigma = int(text.max()) + 1 if n else 1
        self.wavelet = Wavelet(text[sa - 1] if n else text, max(1, int(sigma - 1).bit_length()))
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(text, minlength=sigma))])
        self.lcp = self._lcp(sa, ranks)
        head = self.lcp < most
        head[:1] = True
        self.heads = Bits(head.astype(np.uint8))
        self.sample = np.minimum.reduceat(sa, np.flatnonzero(head)).astype(np.int32) if n else np.zeros(0, np.int32)

    def _lcp(self, sa: np.ndarray, ranks: dict[int, np.ndarray]) -> np.ndarray:
        """Common words of neighbours in suffix order, up to most."""
        a, b = sa[1:], sa[:-1]
        out = np.zeros(max(0, self.n - 1), np.int64)
        for k in sorted(ranks, reverse=True):
            rank = np.concatenate([ranks[k], np.zeros(2 * self.most + 1, np.int64)])
            out += np.where((rank[a + out] == rank[b + out]) & (rank[a + out] > 0), k, 0)
        return np.concatenate([np.zeros(min(1, self.n), np.int64), np.minimum(out, self.most)]).astype(np.min_scalar_type(self.most))

    def parents(self, depth: int, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals that share the first depth words with the suffix at each place."""
        head = self.lcp < depth
        head[:1] = True
        at = np.flatnonzero(head)
        own = np.searchsorted(at, lo, side="right") - 1
        return at[own], np.append(at[1:], self.n)[own]

    def earliest(self, lo: np.ndarray) -> np.ndarray:
        """The earliest place in the text of intervals of most words."""
        return self.sample[self.heads.rank(lo + 1) - 1].astype(np.int64)

    def extend(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the interval of word + what [lo, hi) matches."""
        start = self.first[word]
        return start + self.wavelet.rank(word, lo), start + self.wavelet.rank(word, hi)

    def matching(self, query: np.ndarray, end: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of many texts side by side.

        Text j is query[end[j] - length[j] : end[j]]; ids the index doesn't know are -1. Returns for every place of
        query the length of the longest match that starts there, up to most, and its interval.
        """
        size, low, high = (np.zeros(len(query), np.int64) for _ in range(3))
        order = np.argsort(-length, kind="stable")
        end, length = end[order], length[order]
        lo, hi, got = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64), np.zeros(len(end), np.int64)
        for step in range(int(length[0]) if len(length) else 0):
            alive = int(np.searchsorted(-length, -step, side="left"))  # longer texts come first
            at = end[:alive] - 1 - step
            word = query[at]
            l, h, g = lo[:alive], hi[:alive], got[:alive]
            full = g == self.most
            if full.any():
                l[full], h[full] = self.parents(self.most - 1, l[full])
                g[full] = self.most - 1
            known = (word >= 1) & (word < len(self.first) - 1)
            safe = np.where(known, word, 1 if len(self.first) > 2 else 0)
            a, b = self.extend(safe, l, h)
            a, b = np.where(known, a, 0), np.where(known, b, 0)
            bad = (a >= b) & known & (g > 0)
            while bad.any():  # give up words at the right end until the step fits
                own = np.flatnonzero(bad)
                for depth in np.unique(g[own]):
                    some = own[g[own] == depth]
                    l[some], h[some] = self.parents(int(depth) - 1, l[some])
                g[own] -= 1
                a[own], b[own] = self.extend(word[own], l[own], h[own])
                bad = (a >= b) & known & (g > 0)
            hit = a < b
            l[:], h[:], g[:] = np.where(hit, a, 0), np.where(hit, b, self.n), np.where(hit, g + 1, 0)
            size[at], low[at], high[at] = g, l, h
        return size, low, high
