"""All segmentations of a word into vocabulary units, weighted by unit probabilities."""

from __future__ import annotations

import math
from array import array

import numpy as np

from .textkit import BASE, BASE_INVERSE, GOLDEN, _powers

SLOT_BITS = 21
COLUMNS = 2048


def read_units(path: str) -> tuple[list[bytes], np.ndarray]:
    """Byte strings of the vocabulary's pieces, and their first log-probabilities.

    A word is written with one leading space for the piece mark. Byte pieces stand for their byte, so
    every word has a segmentation. The vocabulary's scores are ranks (0, -1, -2, ...); rank r weighs
    1 / (r + 3), as word and piece frequencies roughly do.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        piece = sp.id_to_piece(i)
        unit = bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()
        w = 1 / (3 + (sp.get_piece_size() if sp.is_byte(i) else min(-sp.get_score(i), 1e6)))
        weight[unit] = weight.get(unit, 0.0) + w
    units = sorted(weight)
    w = np.array([weight[u] for u in units])
    return units, np.log(w / w.sum())


class Lattice:
    def __init__(self, units: list[bytes], log_p: np.ndarray):
        self.log_p, self.longest = log_p, max(map(len, units))
        keys = np.array([self._key(u) for u in units], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.marks = np.zeros(1 << SLOT_BITS, bool)
        self.marks[self.keys >> np.uint64(64 - SLOT_BITS)] = True
        self.lengths = sorted({len(u) for u in units})

    @staticmethod
    def _key(unit: bytes) -> int:
        h = sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(unit))
        return ((h + len(unit) * GOLDEN) * GOLDEN) % (1 << 64)

    def _edges(self, text: np.ndarray):
        """For each unit length: unit number (or -1) at every start, of padded byte rows."""
        m, n = text.shape
        total = np.zeros((m, n + 1), np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n), axis=1, out=total[:, 1:])
        inverse = _powers(BASE_INVERSE, n)
        for k in self.lengths:
            if k > n:
                return
            h = ((total[:, k:] - total[:, : n - k + 1]) * inverse[: n - k + 1] + np.uint64(k * GOLDEN % (1 << 64))) * np.uint64(GOLDEN)
            row, col = np.nonzero(self.marks[h >> np.uint64(64 - SLOT_BITS)])
            found = h[row, col]
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            good = self.keys[at] == found
            yield k, row[good], col[good], self.order[at[good]]

    def _weights(self, text: np.ndarray):
        m, n = text.shape
        dense, sparse = [], []
        for k, row, col, unit in self._edges(text):
            if len(row):
                w = np.full((m, n - k + 1), -np.inf)
                w[row, col] = self.log_p[unit]
                dense.append((k, w))
                sparse.append((k, row, col, unit))
        return dense, sparse

    def _forward(self, text: np.ndarray) -> np.ndarray:
        """Log-probability of every prefix. COLUMNS places are worked on at once, so a long word takes a few numbers a byte."""
        m, n = text.shape
        if m == 1:
            return np.array(self._walk(text, False))[None]
        alpha = np.full((m, n + 1), -np.inf)
        alpha[:, 0] = 0.0
        for at in range(0, n, COLUMNS):
            low, high = max(0, at - self.longest), min(n, at + COLUMNS)
            dense, _ = self._weights(text[:, low:high])
            for j in range(at + 1, high + 1):
                alpha[:, j] = _log_sum([alpha[:, j - k] + w[:, j - k - low] for k, w in dense if j - k >= low])
        return alpha

    def _walk(self, text: np.ndarray, back: bool) -> array:
        """Of one word, the log-probability of every prefix, or with `back` of every suffix: unit by unit, with no array a place."""
        n = text.shape[1]
        out = array("d", [-math.inf]) * (n + 1)
        out[n if back else 0] = 0.0
        starts = range(0, n, COLUMNS)
        for at in reversed(starts) if back else starts:
            high = min(n, at + COLUMNS)
            low, far = (at, min(n, high + self.longest)) if back else (max(0, at - self.longest), high)
            ending: list[list] = [[] for _ in range(high - at)]
            for k, _, col, unit in self._edges(text[:, low:far]):
                # the place a unit leads to, and the one it comes from
                to, of = (col + low, col + low + k) if back else (col + low + k, col + low)
                here = (to >= at) & (to < high) if back else (to > at) & (to <= high)
                for x, y, p in zip((to[here] - at - (not back)).tolist(), of[here].tolist(), self.log_p[unit[here]].tolist(), strict=True):
                    ending[x].append((y, p))
            for j in reversed(range(high - at)) if back else range(high - at):
                terms = [out[y] + p for y, p in ending[j]]
                top = max(terms, default=-math.inf)
                if top > -math.inf:
                    out[at + j + (not back)] = top + math.log(sum([math.exp(x - top) for x in terms]))
        return out

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the summed probability of all segmentations of each word."""
        out = np.empty(len(words))
        for at, size, text in _padded(words):
            out[at] = self._forward(text)[np.arange(len(at)), size]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of every unit over the words, each taken `counts` times."""
        total = np.zeros(len(self.log_p))
        for which, size, text in _padded(words):
            m, n = text.shape
            alpha = self._forward(text)
            whole = alpha[np.arange(m), size]
            beta = np.full((m, n + 1), -np.inf)
            beta[np.arange(m), size] = 0.0
            if m == 1:
                beta[0] = self._walk(text, True)
            for at in range((n - 1) // COLUMNS * COLUMNS, -1, -COLUMNS):
                high = min(n, at + COLUMNS)
                block = text[:, at : min(n, high + self.longest)]
                if m == 1:
                    sparse = self._edges(block)
                else:
                    dense, sparse = self._weights(block)
                    for j in range(high - 1, at - 1, -1):
                        beta[:, j] = _log_sum([beta[:, j], *[beta[:, j + k] + w[:, j - at] for k, w in dense if j + k <= n and j - at < w.shape[1]]])
                for k, row, col, unit in sparse:
                    mine = col < high - at
                    r, c, u = row[mine], col[mine] + at, unit[mine]
                    use = np.exp(alpha[r, c] + self.log_p[u] + beta[r, c + k] - whole[r]) * counts[which][r]
                    total += np.bincount(u, use, minlength=len(total))
        return total


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if not terms:
        return -np.inf
    t = np.stack(terms)
    top = t.max(axis=0)
    np.subtract(t, np.where(np.isfinite(top), top, 0.0), out=t)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(t).sum(axis=0))


def _padded(words: list[bytes], cells: int = 120_000):
    """Groups of words of similar length as rows of bytes with a leading space, zeros behind."""
    size = np.array([len(w) for w in words]) + 1
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        to, width = at + 1, int(size[order[at]])
        limit = width + max(1, width // 4)
        while to < len(order) and size[order[to]] <= limit and (to - at) * int(size[order[to]]) < cells:
            to += 1
        group = order[at:to]
        n = int(size[group[-1]])
        text = np.frombuffer(b"".join((b" " + words[i]).ljust(n, b"\0") for i in group), np.uint8).reshape(len(group), n)
        yield group, size[group], text
        at = to
