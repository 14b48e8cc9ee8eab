"""Hashed character n-grams of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np


def code_points(text: bytes | None) -> np.ndarray:
    """Lower-cased code points with runs of white space as one space, and a
    space at both ends."""
    s = " " + " ".join((text or b"").decode("utf-8", "replace").lower().split()) + " "
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(points: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Distinct hash numbers (0 to 2**bits - 1) of the n-grams of the orders."""
    seen = np.zeros(1 << bits, bool) if len(points) > (1 << bits) // 8 else None
    parts = []
    h, have = np.full(len(points), 0x9E3779B1, np.uint64), 0
    for n in sorted(orders):  # an n-gram's hash goes on from that of the next shorter order
        if len(points) < n:
            break
        for j in range(have, n):
            h = (h[:len(points) - j] ^ points[j:]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        have = n
        g = h * np.uint64(2 * n + 1)
        g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        g = (g >> np.uint64(64 - bits - 3)) & np.uint64((1 << bits) - 1)
        if seen is not None:
            seen[g] = True
        else:
            parts.append(g.astype(np.int64))
    if seen is not None:
        return np.flatnonzero(seen)
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
