"""Vectorised word and shingle hashing over batches of whole texts (numpy, no per-word Python)."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_COEF = np.array([(0xD6E8FEB86659FD93 * (2 * i + 3) ** 7 + 1) & (1 << 64) - 1 | 1 for i in range(SHINGLE)], dtype=np.uint64)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables["up"]) < n:
        size = 1 << max(20, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word; words are runs of bytes above 0x20 in the lower-cased text, in order."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    ends_of = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    solid = buf > 32
    edge = np.flatnonzero(np.diff(solid.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = _powers(len(buf))
    prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts]), np.searchsorted(ends_of, starts, side="right")


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bounds): the hashes of five-word shingles of text i are hash[bounds[i]:bounds[i + 1]], repeats kept.

    A text of one to four words has one shingle of all its words; a text without words has none.
    """
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    made = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(counts)])
    bounds = np.concatenate([[0], np.cumsum(made)])
    full = len(words) - SHINGLE + 1
    out = np.empty(bounds[-1], dtype=np.uint64)
    if full > 0:
        acc = words[:full] * _COEF[0]
        for k in range(1, SHINGLE):
            acc += words[k : k + full] * _COEF[k]
        whole = owner[:full] == owner[SHINGLE - 1 :]
        slot = np.repeat(counts >= SHINGLE, made)
        out[slot] = acc[whole]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        own = words[first[i] : first[i + 1]]
        out[bounds[i]] = (own * _COEF[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), bounds


def distinct_shingles(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, bounds = shingle_hashes(texts)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
