"""Hashes of all byte strings of one length in a text, vectorised."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
MIX = [int(x) | 1 for x in _RNG.integers(0, 2**64, 16, dtype=np.uint64)]


def stir(x: np.ndarray, k: int) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(MIX[k])
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place, by doubling (garbage in the last places)."""
    powers = [_BYTE[data]]
    size = 1
    while size * 2 <= gram:
        h = powers[-1]
        g = h * np.uint64(MIX[len(powers)])
        g[:-size] += h[size:]
        powers.append(stir(g, len(powers) + 5))
        size *= 2
    total, at = None, 0
    for level in range(len(powers) - 1, -1, -1):
        if gram - at >= 1 << level:
            part = powers[level]
            if total is None:
                total = part.copy()
            else:
                total *= np.uint64(MIX[12])
                total[:len(total) - at] += part[at:]
            at += 1 << level
    return stir(total, 13)
