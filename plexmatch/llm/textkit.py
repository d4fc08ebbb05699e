"""Vectorised words, hashes and byte n-grams of a batch of texts."""

from __future__ import annotations

import numpy as np

#: Multipliers of the 64-bit finaliser and an odd base with its inverse modulo 2**64.
MIX_1, MIX_2, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def blank_table() -> np.ndarray:
    """True for the bytes that separate words: 0x20 and 0x09 to 0x0D."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


BLANK = blank_table()
#: Places in a word whose byte values are tabled; later ones are worked out.
PLACES = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


#: Words of up to so many bytes are told apart by their first and last eight and their length.
SHORT = 16
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: A value for each byte at each of a word's first places.
_BYTES = mix(np.arange(1, 256 * PLACES + 1, dtype=np.uint64) * np.uint64(GOLDEN))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, and where each begins, with the end as one more."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _fold_table() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


_FOLD = _fold_table()


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A to Z in lower case."""
    return _FOLD[data]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    have = min(1, n)
    while have < n:  # doubling
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


class Words:
    """Words of a batch of texts: byte spans, 64-bit hashes, and each text's range of words."""

    def __init__(self, texts: list[bytes]):
        data, offsets = joined(texts)
        n = len(data)
        inside = ~BLANK[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[:-1][offsets[:-1] < n]
        first[cuts] = inside[cuts]
        cuts = offsets[1:][offsets[1:] > 0] - 1
        last[cuts] = inside[cuts]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of text i: places[i] to places[i + 1]
        self.places = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.places)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def keys(self, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, size) of each word: its first eight bytes, its last eight (zero if there are fewer), its length.

        Two words of at most SHORT bytes are equal if these are.
        """
        data = np.concatenate([_FOLD[self.data] if fold_case else self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))  # the eight bytes from every place
        size = self.ends - self.starts
        first = eight[self.starts] & _MASKS[np.minimum(size, 8)]
        last = eight[np.maximum(self.ends - 8, 0)]
        last[size < 8] = 0
        return first, last, size

    def hashes(self, fold_case: bool = False) -> np.ndarray:
        """64 bits of each word, a hash of all its bytes and its length."""
        first, last, size = self.keys(fold_case)
        h = mix(mix(first + size.astype(np.uint64) * np.uint64(GOLDEN)) + last)
        long = np.flatnonzero(size > SHORT)
        if len(long):  # the bytes between: a random value for each byte at its place
            at, step, begin = self._between(long)
            middle = self.data[at]
            key = step << 8
            key |= _FOLD[middle] if fold_case else middle
            value = _BYTES.take(key, mode="clip")
            far = np.flatnonzero(key >= len(_BYTES))
            value[far] = mix((key[far].astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN))
            h[long] = mix(h[long] + np.add.reduceat(value, begin))
        return h

    def _between(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words of over SHORT bytes, the places of the bytes that keys() leaves out, their numbers in the word, and where each word begins among them."""
        size = self.ends[which] - self.starts[which] - SHORT
        begin = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(begin, size)
        return np.repeat(self.starts[which] + 8, size) + step, step, begin

    def agree(self, which: np.ndarray, data: np.ndarray, starts: np.ndarray, fold_case: bool = False) -> np.ndarray:
        """Whether words `which`, of over SHORT bytes, agree between their first and last eight with those of their length in `data` (folded already) at `starts`."""
        at, step, begin = self._between(which)
        mine, other = self.data[at], data[np.repeat(starts + 8, self.ends[which] - self.starts[which] - SHORT) + step]
        return np.add.reduceat(((_FOLD[mine] if fold_case else mine) != other).astype(np.int64), begin) == 0

    def distinct(self, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(a word's place of each distinct word, number of every word's distinct word): words are told apart by their bytes, not their hashes."""
        h = self.hashes(fold_case)
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        first, last, size = self.keys(fold_case)
        of = one[which]
        good = (first == first[of]) & (last == last[of]) & (size == size[of])
        long = np.flatnonzero(good & (size > SHORT) & (of != np.arange(len(of))))
        data = _FOLD[self.data] if fold_case else self.data
        if len(long):
            good[long] = self.agree(long, data, self.starts[of[long]], fold_case)
        if not good.all():  # hashes that collide
            number: dict[bytes, int] = {}
            data = data.tobytes()
            which = np.array([number.setdefault(data[s:e], len(number)) for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True)], np.int64)
            _, one = np.unique(which, return_index=True)
        return one, which


def shingles(hashes: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of k words; a text of fewer words, but not none, has one run of all of them."""
    counts = np.diff(places)
    n = len(hashes)
    full = max(0, n - k + 1)
    roll = np.zeros(full, np.uint64)
    for j in range(k):
        roll = roll * np.uint64(BASE) + hashes[j : j + full]
    owner = np.repeat(np.arange(len(counts)), counts)
    good = np.arange(full) + k <= places[1:][owner[:full]]
    out, who = mix(roll[good]), owner[:full][good]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            x = counts[d]
            for h in hashes[places[d] : places[d + 1]]:
                x = (int(x) * BASE + int(h)) % (1 << 64)
            extra[i] = x
        out, who = np.r_[out, mix(extra)], np.r_[who, short]
    return out, who


def byte_grams(data: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every run of n bytes that lies in one text."""
    full = max(0, len(data) - n + 1)
    h = np.zeros(full, np.uint32)
    for j in range(n):
        h = h * np.uint32(0x01000193) ^ data[j : j + full]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size)[:full]
    good = np.arange(full) + n <= offsets[1:][owner]
    return h[good], owner[good]
