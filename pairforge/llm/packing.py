"""Arrays of whole numbers as compressed bytes."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Byte plane by byte plane, compressed; planes that are all zero cost next to nothing."""
    v = np.ascontiguousarray(values.astype("<u8"))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()
