"""Words and word-window hashes of whole texts, vectorised per block.

A word is a maximal run of characters other than space and \\x09-\\x0D, which
is what ``bytes.split()`` yields on UTF-8."""

from __future__ import annotations

import numpy as np
import xxhash

# odd multipliers of the two polynomial window hashes (arithmetic mod 2**64)
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Vocab(dict):
    """word -> 0, 1, 2, ... in order of first sight."""

    def __missing__(self, word):
        i = self[word] = len(self)
        return i


def word_ids(words: list[bytes], vocab: Vocab) -> np.ndarray:
    return np.fromiter(map(vocab.__getitem__, words), dtype=np.int32, count=len(words))


def word_hashes(vocab: Vocab) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every word, by word id."""
    raw = b"".join(map(xxhash.xxh3_128_digest, vocab))
    both = np.frombuffer(raw, dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def window_hash(h: np.ndarray, k: int, mult: np.uint64) -> np.ndarray:
    """Polynomial hash of every k consecutive entries (length max(0, n-k+1)),
    by doubling: a window of 2m is two windows of m."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, have = None, 0
        power, length, step = h, 1, mult  # windows of `length`, mult**length
        while True:
            if k & length:
                if out is None:
                    out, have = power, length
                else:
                    m = n - have - length + 1
                    out = out[:m] * step + power[have:have + m]
                    have += length
            length *= 2
            if length > k:
                return out[:n - k + 1]
            m = n - length + 1
            power = power[:m] * step + power[length // 2:length // 2 + m]
            step = step * step


def sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """op (np.minimum / np.maximum) over every w consecutive entries."""
    out, have = a, 1
    while have < w:
        s = min(have, w - have)
        out = op(out[:len(out) - s], out[s:])
        have += s
    return out


def spread(starts: np.ndarray, lengths, n: int) -> np.ndarray:
    """Boolean mask of length n that covers [start, start + length)."""
    up = np.bincount(starts, minlength=n + 1)[:n]
    down = np.bincount(np.minimum(starts + lengths, n), minlength=n + 1)[:n]
    return np.cumsum(up - down) > 0
