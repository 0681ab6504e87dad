"""Sorted arrays of keys and counts as compressed values, so that a shuffle of very many keys stays small."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays as one compressed value."""
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), a.size)]], dtype=np.int64)
    planes = lambda a: np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.size else b""  # noqa: E731  first bytes first: they compress best together
    raw = head.tobytes() + b"".join(map(planes, arrays))
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    head = np.frombuffer(raw, dtype=np.int64, count=1 + 2 * n)[1:]
    at, out = 8 * (1 + 2 * n), []
    for char, size in zip(head[::2], head[1::2]):
        kind = np.dtype(chr(char))
        a = np.frombuffer(raw, dtype=np.uint8, count=size * kind.itemsize, offset=at)
        at += a.nbytes
        out.append(a if kind.itemsize == 1 and kind == np.uint8 else np.ascontiguousarray(a.reshape(kind.itemsize, -1).T).view(kind).ravel())
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type."""
    top = int(a.max()) if a.size else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def packed_keys(keys: np.ndarray) -> list[np.ndarray]:
    """Sorted 64-bit keys as steps of six bytes where they fit."""
    steps = np.diff(keys, prepend=np.uint64(0))
    if keys.size and int(steps[1:].max(initial=0)) < 1 << 48:
        return [keys[:1], np.ascontiguousarray(steps[1:].view(np.uint8).reshape(-1, 8)[:, :6]).ravel()]
    return [keys, np.zeros(0, dtype=np.uint8)]


def unpacked_keys(first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    if not steps.size:
        return first
    wide = np.zeros((steps.size // 6 + 1, 8), dtype=np.uint8)
    wide[1:, :6] = steps.reshape(-1, 6)
    out = wide.view(np.uint64).ravel()
    out[0] = first[0]
    return np.cumsum(out, dtype=np.uint64)


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the key space begins in sorted keys."""
    edges = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
