"""Arrays of numbers as compressed bytes, for what tasks hand to each other."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, by byte planes, compressed."""
    n = len(columns[0])
    planes = [c.view(np.uint8).reshape(n, -1).T.tobytes() for c in columns]
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(1).compress(b"".join(planes))


def unpack(blob: bytes, types: list) -> list[np.ndarray]:
    n, out, k = int.from_bytes(blob[:8], "little"), [], 0
    raw = zstandard.ZstdDecompressor().decompress(blob[8:])
    for t in types:
        w = np.dtype(t).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * w, k).reshape(w, n).T.copy().view(t).ravel())
        k += n * w
    return out
