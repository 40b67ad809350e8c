"""Word shingle sets of whole texts as 64-bit hashes, computed for a block of texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class ShingleSets:
    """Sorted distinct hashes of the `words`-word shingles of texts.

    A-Z are lower-cased; words are runs of bytes other than space and tab to carriage return.
    A text of fewer words is one shingle, one without words has an empty set.
    """

    def __init__(self, words: int):
        self.words = words
        self.up, self.down = _powers(_BASE, _BLOCK), _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), _BLOCK)

    def _block(self, raw: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(_BASE, len(data)), _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), len(data))
        space = _SPACE[data]
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)])
        word = mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]))
        shingle = np.zeros(max(0, len(word) - self.words + 1), np.uint64)
        for k in range(self.words):
            shingle = mixed(shingle + word[k : k + len(shingle)] + np.uint64(k))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= self.words:
                yield np.unique(shingle[a : b - self.words + 1])
            else:
                h = np.full(min(1, b - a), b - a, np.uint64)
                for k in range(b - a):
                    h = mixed(h + word[a + k : a + k + 1] + np.uint64(k + 16))
                yield h

    def sets(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        block: list[bytes] = []
        size = 0
        for text in texts:
            raw = text.encode().lower()
            if block and size + len(raw) >= _BLOCK - len(block) - 2:
                yield from self._block(block)
                block, size = [], 0
            block.append(raw)
            size += len(raw)
        if block:
            yield from self._block(block)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
