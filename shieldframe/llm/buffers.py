"""Whole Arrow columns of texts as NumPy buffers, for work on all bytes of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary or string column's bytes end to end (uint8), and the offsets of its values (one more than values). Nulls are empty."""
    if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type):
        kind = np.int64
    elif pa.types.is_binary(column.type) or pa.types.is_string(column.type):
        kind = np.int32
    else:
        raise TypeError(f"no text: {column.type}")
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (constants of a common finalizer)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def need(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
