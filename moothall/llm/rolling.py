"""Words and word windows of many texts as 64-bit hashes, computed on whole byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are handled in chunks of about this size; one text is never cut

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93
_MIX = 0xFF51AFD7ED558CCD


class WordHasher:
    """Words are runs of bytes marked in `is_word` (256 flags) after A-Z are lower-cased."""

    def __init__(self, is_word: np.ndarray):
        self.is_word = is_word
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.power = self.inverse = np.ones(0, np.uint64)

    def _powers(self, n: int):
        if len(self.power) < n:
            size = max(n, CHUNK_BYTES + 1)
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.power[:n], self.inverse[:n]

    def words(self, data: np.ndarray):
        """Lower-cased bytes, and where their words start and end."""
        low = self.lower[data]
        inside = np.zeros(len(low) + 2, np.int8)
        inside[1:-1] = self.is_word[low]
        edges = np.diff(inside)
        return low, np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)

    def hashes(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash per word: a polynomial of its bytes, mixed."""
        power, inverse = self._powers(len(low) + 1)
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])  # a NUL byte counts, too
        found = (sums[end] - sums[start]) * inverse[start]
        found ^= found >> np.uint64(31)
        return found * np.uint64(_MIX)

    @staticmethod
    def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
        """One hash per window of `length` consecutive words; the high bits are the best mixed."""
        n = max(0, len(words) - length + 1)
        total = np.zeros(n, np.uint64)
        for k in range(length):
            total = total * np.uint64(_STEP) + words[k: k + n]
        total ^= total >> np.uint64(29)
        return total * np.uint64(_MIX)

    def split(self, texts: list[bytes], separator: bytes):
        """Lower-cased bytes of all texts, word bounds, each text's end and its first word (one more at the end)."""
        low, start, end = self.words(np.frombuffer(separator.join(texts) + separator, np.uint8))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return low, start, end, ends, np.searchsorted(start, np.concatenate([[0], ends]))


def chunks(values: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about `limit` bytes together, with the place of the first; null is the empty text."""
    at, held, size = 0, [], 0
    for k, value in enumerate(values):
        held.append((value.as_py() or "").encode())
        size += len(held[-1]) + 1
        if size >= limit:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held
