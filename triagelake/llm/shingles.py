"""Hashed word shingles of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; a longer word is hashed whole.
PIECE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class WordHasher:
    """64-bit hashes of the words (runs of non-space bytes) of a buffer: a
    polynomial over the bytes, from prefix sums."""

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        self.letter = rng.integers(1, 1 << 63, 256, np.uint64)
        self.power = self._powers(BASE, PIECE)
        self.inverse = self._powers(pow(BASE, -1, 1 << 64), PIECE)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.cumprod(p, dtype=np.uint64)

    def words(self, buf: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start offset, hash) of every word of ``buf``."""
        starts, hashes, at = [], [], 0
        while at < len(buf):
            end = min(len(buf), at + PIECE)
            if end < len(buf):  # cut behind a space
                part = SPACE[np.frombuffer(buf, np.uint8, end - at, at)]
                last = int(part[::-1].argmax())
                while not part.any() and end < len(buf):
                    nxt = np.flatnonzero(SPACE[np.frombuffer(buf, np.uint8, min(PIECE, len(buf) - end), end)])
                    end = end + int(nxt[0]) + 1 if len(nxt) else min(len(buf), end + PIECE)
                    part, last = SPACE[np.frombuffer(buf, np.uint8, end - at, at)], 0
                end -= last
            a = np.frombuffer(buf, np.uint8, end - at, at)
            if len(a) > len(self.power):
                self.power = self._powers(BASE, len(a))
                self.inverse = self._powers(pow(BASE, -1, 1 << 64), len(a))
            space = np.concatenate(([True], SPACE[a], [True]))
            edge = np.flatnonzero(space[1:] != space[:-1])
            s, e = edge[::2], edge[1::2]
            if len(s):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.letter[a] * self.power[:len(a)], dtype=np.uint64)))
                starts.append(s + at)
                hashes.append(mix((sums[e] - sums[s]) * self.inverse[s]))
            at = end
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.concatenate(starts), np.concatenate(hashes)


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words."""
    count = len(words) - n + 1
    h = np.full(count, n, np.uint64)
    for j in range(n):
        h = mix(h * np.uint64(BASE) + words[j:j + count])
    return h


def shingle_sets(hasher: WordHasher, texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles, A-Z
    lower-cased; a text of fewer words is one shingle, one without none."""
    low = [(t or b"").lower() for t in texts]
    starts, words = hasher.words(b"\n".join(low))
    ends = np.cumsum([len(t) + 1 for t in low])
    cut = np.searchsorted(starts, ends)
    all_of = chained(words, n) if len(words) >= n else np.empty(0, np.uint64)
    out, first = [], 0
    for last in cut.tolist():
        count = last - first
        if count >= n:
            out.append(np.unique(all_of[first:last - n + 1]))
        elif count:
            out.append(chained(words[first:last], count))
        else:
            out.append(np.empty(0, np.uint64))
        first = last
    return out
