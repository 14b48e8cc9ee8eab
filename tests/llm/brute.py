"""Brute-force versions to hold results against."""

import hashlib
import re


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def closure(ids, links):
    """Smallest id reachable, per id."""
    low = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                moved = True
    return low


def brute_components(rows, n, num, den):
    """{id: (set size, component)} by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in rows}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                links.append((a, b))
    low = closure(ids, links)
    return {i: (len(sets[i]), low[i]) for i in ids}


def brute_repeats(rows, match=200):
    """{id: (bytes, removed, spans, digest of the rest)} by a table of all windows."""
    texts = {i: (t or "").encode() for i, t in rows}
    count = {}
    for t in texts.values():
        for s in range(len(t) - match + 1):
            count[t[s:s + match]] = count.get(t[s:s + match], 0) + 1
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for s in range(len(t) - match + 1):
            if count[t[s:s + match]] > 1:
                gone[s:s + match] = b"\1" * match
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        rest = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out
