"""A compressed full-text index over word numbers: wavelet tree of the Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

#: Bits of the bytes 0 to 255.
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class BitVector:
    """Bits with a count of ones before each 64-bit word; rank by one table look-up and a popcount."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        pad[: len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.r_[0, np.cumsum(ones)[:-1]].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletTree:
    """Level by level, most significant bit first; each level is kept stably sorted by the bits above."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.zeros = levels, [], []
        s = symbols
        for k in range(levels - 1, -1, -1):
            bit = (s >> k) & 1
            self.bits.append(BitVector(bit.astype(np.uint8)))
            self.zeros.append(int((bit == 0).sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])  # all zeros of the level first

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often symbol stands before lo and before hi."""
        start = np.zeros(len(symbol), np.int64)
        for level in range(self.levels):
            vector, zeros = self.bits[level], self.zeros[level]
            one = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            r = [vector.rank(x) for x in (start, lo, hi)]
            start, lo, hi = (np.where(one, zeros + q, x - q) for x, q in zip((start, lo, hi), r, strict=True))
        return lo - start, hi - start


def suffix_order(text: np.ndarray, context: int) -> np.ndarray:
    """Suffixes sorted by their first `context` symbols at least; ties by place. Ends by 0, the least."""
    n = len(text)
    rank = text.astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while k < context:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        rank = new
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


class FMIndex:
    """Index of several word sequences, each closed by a separator that no pattern holds."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray, context: int):
        """sequences: word numbers from 1, one sequence after the other."""
        n = len(sequences) + len(lengths)
        text = np.zeros(n, np.int64)
        ends = np.cumsum(lengths) + np.arange(len(lengths))
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = sequences
        order = suffix_order(text, context)
        bwt = text[order - 1]
        size = int(text.max()) + 1
        self.n = n
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=size))]
        self.tree = WaveletTree(bwt, max(1, int(size).bit_length()))

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the patterns with one more symbol in front."""
        a, b = self.tree.rank(symbol, lo, hi)
        return self.first[symbol] + a, self.first[symbol] + b

    def repeat_start(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Matching statistics, read backwards: least f >= begin such that text[f:end] stands twice or more."""
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        f = end.copy()
        live = np.flatnonzero(f > begin)
        while len(live):
            a, b = self.step(text[f[live] - 1], lo[live], hi[live])
            twice = b - a >= 2
            live, a, b = live[twice], a[twice], b[twice]
            lo[live], hi[live] = a, b
            f[live] -= 1
            live = live[f[live] > begin[live]]
        return f


def repeated_windows(index: FMIndex, text: np.ndarray, start: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """For each sequence text[start : start + length], a 64-bit mask of its windows that stand twice or more.

    One backward search from a sequence's end tells of all windows at once if the whole is repeated.
    Otherwise windows are tried from the left: a search from a window's end that breaks off at f rules
    out every window that starts before f, so text that is not repeated is crossed in long leaps.
    """
    masks = np.zeros(len(start), np.uint64)
    windows = length - window + 1
    f = index.repeat_start(text, start, start + length) - start
    # windows from f on end before the sequence does, hence are repeated
    many = np.clip(windows - f, 0, 64)
    masks = np.where(many > 0, ((np.uint64(1) << np.minimum(many, 63).astype(np.uint64)) - np.uint64(1)) << np.minimum(f, 63).astype(np.uint64), masks)
    stop = np.minimum(f, windows)
    at = np.zeros(len(start), np.int64)
    live = np.flatnonzero(at < stop)
    while len(live):
        here = start[live] + at[live]
        got = index.repeat_start(text, here, here + window) - here
        hit = got == 0
        masks[live[hit]] |= np.uint64(1) << at[live[hit]].astype(np.uint64)
        at[live] += np.maximum(1, got)
        live = live[at[live] < stop[live]]
    return masks
