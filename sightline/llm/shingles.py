"""Word shingles inside tasks: words, distinct 64-bit shingle hashes, parity bitmaps."""

from __future__ import annotations

import numpy as np
import xxhash


def lowered_words(text: bytes | None) -> list[bytes]:
    """Words of the text with A-Z in lower case; ``bytes.split`` parts at the same six characters."""
    return (text or b"").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words, of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.int64)
    line = b" ".join(words)
    if len(words) <= size:
        found = [xxhash.xxh3_64_intdigest(line)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-size].tolist()]
        hashed = xxhash.xxh3_64_intdigest
        found = [hashed(line[s:e]) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def shortened(hashes: np.ndarray) -> np.ndarray:
    """The distinct low halves of the hashes, sorted."""
    return np.unique(hashes.view(np.uint64).astype(np.uint32))


def parity(values: np.ndarray, least: int) -> np.ndarray:
    """A bitmap of a power of two bits, ``least`` or more; set where an odd number of values fall.

    Two sets differ in at least as many values as their bitmaps differ in bits.
    """
    bits = max(64, 1 << int(least - 1).bit_length())
    odd = np.bincount(values.astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")
