"""Numeric arrays as one compressed value, for shuffles of many small keys."""

from __future__ import annotations

import struct

import numpy as np


def to_blob(*arrays: np.ndarray) -> bytes:
    """Byte planes of each array, compressed together; sorted keys and small numbers take little room."""
    import zstandard

    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        parts.append(struct.pack("<4sQ", a.dtype.str.encode(), len(a)))
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def from_blob(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 4
    for _ in range(struct.unpack_from("<I", raw)[0]):
        name, n = struct.unpack_from("<4sQ", raw, at)
        kind, at = np.dtype(name.rstrip(b"\0").decode()), at + 12
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.empty(0, kind))
        at += n * kind.itemsize
    return out


def key_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of ``ranges`` equal parts of the 64-bit space each key lies in."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def by_range(parts: np.ndarray, *arrays: np.ndarray):
    """``(part, blob)`` for each part that occurs, entries in their given order."""
    order = np.argsort(parts, kind="stable")
    parts, arrays = parts[order], [a[order] for a in arrays]
    cuts = np.append(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])), len(parts)) if len(parts) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(parts[a]), to_blob(*[x[a:b] for x in arrays])
