"""Columns of whole numbers as compressed bytes: only the bytes that a column needs, each apart from the others."""

from __future__ import annotations

import numpy as np
import zstandard


def squeezed(*columns: np.ndarray) -> bytes:
    """Equally long columns without negative numbers; steps of sorted ones take the least."""
    columns = [c.astype(np.uint64) for c in columns]
    wide = bytes(max(1, (int(c.max()).bit_length() + 7) // 8) for c in columns)
    planes = [c.view(np.uint8).reshape(-1, 8)[:, k] for c, w in zip(columns, wide) for k in range(w)]
    return bytes([len(wide)]) + wide + zstandard.ZstdCompressor(level=1).compress(np.stack(planes).tobytes())


def unsqueezed(raw: bytes) -> list[np.ndarray]:
    wide = raw[1:1 + raw[0]]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1 + raw[0]:]), dtype=np.uint8).reshape(sum(wide), -1)
    columns, at = [], 0
    for w in wide:
        column = planes[at].astype(np.int64)
        for k in range(1, w):
            column |= planes[at + k].astype(np.int64) << 8 * k
        columns.append(column)
        at += w
    return columns
