"""Choices of fingerprint blocks that near fingerprints share."""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb


def layout(total: int, radius: int) -> list[int]:
    """Masks of the shards: for the number of blocks with the least work for ``total``
    fingerprints, one mask for every choice of ``blocks - radius`` blocks."""
    best = None
    for blocks in range(radius + 1, min(64, 2 * radius + 8) + 1):
        width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
        bits = sum(sorted(width)[: blocks - radius])
        work = comb(blocks, radius) * (1 + total / 2**bits / 8)
        if best is None or work < best[0]:
            best = work, width
    width = best[1]
    parts = [((1 << w) - 1) << b for w, b in zip(width, accumulate([0, *width]))]
    return [sum(chosen) for chosen in combinations(parts, len(parts) - radius)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask
