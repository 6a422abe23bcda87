"""Arrays of numbers as compressed strings, which move in place of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes mixed again (wraps around: call it under ``np.errstate(over="ignore")``)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def zipped(values: np.ndarray) -> bytes:
    """Unsigned integers as a compressed string: the size of one, that of all, and their bytes by place."""
    raw = np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return values.itemsize.to_bytes(1, "little") + len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def increasing(values: np.ndarray) -> bytes:
    """64-bit ones in order, by their differences; ``unzipped`` takes their sums."""
    return zipped(np.diff(values, prepend=np.uint64(0)))


def unzipped(data: bytes, sums: bool = False) -> np.ndarray:
    size, length = data[0], int.from_bytes(data[1:9], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[9:], length, asbytes=True), np.uint8)
    values = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(f"u{size}")
    return np.cumsum(values, dtype=np.uint64) if sums else values
