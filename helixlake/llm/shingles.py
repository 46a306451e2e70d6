"""Word shingles and their minima, as numpy kernels for use inside Spark tasks."""

from __future__ import annotations

import numpy as np

from helixlake.llm.common import Memory

U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class WordHashes(Memory):
    """64-bit hashes of words."""

    def __init__(self):
        import xxhash

        super().__init__(xxhash.xxh3_64_intdigest)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def words(text: bytes | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a UTF-8 text, with A-Z in lower case."""
    return text.lower().split() if text else []


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `width` words; of the whole where there are fewer; empty for none.

    Over the n shingles of a corpus the chance that any two share a hash is n^2 / 2^65; within a pair of documents,
    where sets are compared, it is nil in practice.
    """
    n = len(hashes)
    if not n:
        return hashes
    take = min(width, n)
    odd = mixed(np.arange(1, take + 1, dtype=U)) | U(1)
    h = hashes[: n - take + 1] * odd[0]
    for k in range(1, take):
        h = h + hashes[k : n - take + 1 + k] * odd[k]
    return np.unique(mixed(h + U(take)))


class Minima:
    """Minima of sets under `count` universal hashes (multiply-add modulo 2^64 of mixed values), the upper 32 bits."""

    def __init__(self, count: int, seed: int = 20240229):
        k = np.arange(1, count + 1, dtype=U) + U(seed)
        self.a, self.b = mixed(k * U(2)) | U(1), mixed(k * U(2) + U(1))

    def of(self, sets: list[np.ndarray], block: int = 32_768) -> np.ndarray:
        """One row for each set; none of them may be empty."""
        out = np.empty((len(sets), len(self.a)), np.uint32)
        start = 0
        while start < len(sets):
            stop, size = start, 0
            while stop < len(sets) and (stop == start or size + len(sets[stop]) <= block):
                size += len(sets[stop])
                stop += 1
            x = np.concatenate(sets[start:stop])
            at = np.cumsum([0, *map(len, sets[start : stop - 1])])
            for j, (a, b) in enumerate(zip(self.a, self.b)):
                y = x * a
                y += b
                out[start:stop, j] = np.minimum.reduceat(y, at) >> U(32)
            start = stop
        return out


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of the bands of `rows` minima each, different from band to band; one row for each document."""
    n, count = minima.shape
    x = minima.reshape(n, count // rows, rows).astype(U)
    odd = mixed(np.arange(7, 7 + rows, dtype=U)) | U(1)
    h = mixed(np.arange(count // rows, dtype=U))[None, :] + np.zeros((n, 1), U)
    for k in range(rows):
        h = mixed(h ^ (x[:, :, k] * odd[k]))
    return h
