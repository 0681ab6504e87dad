"""Words and 64-bit keys in numpy, for functions that tasks run on Arrow batches."""

from __future__ import annotations

import numpy as np


def mixed(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """64-bit hash of two 64-bit numbers each."""
    second = b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9) if isinstance(b, np.ndarray) else np.uint64((b * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) % 2**64)
    x = a * np.uint64(0x9E3779B97F4A7C15) + second
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def vocabulary(lists) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words of all texts, given as lists one after another, as numbers; the distinct words, and where each text begins."""
    seen: dict[bytes, int] = {}
    add = seen.setdefault
    each = [np.fromiter((add(w, len(seen)) for w in ws), dtype=np.int32, count=len(ws)) for ws in lists]
    begins = np.cumsum([0, *map(len, each)])
    return np.concatenate([*each, np.zeros(0, dtype=np.int32)]), list(seen), begins


def hashes(distinct: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
