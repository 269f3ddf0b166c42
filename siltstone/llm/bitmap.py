"""Sets of 64-bit hashes as bitmaps of a fixed largest size: they say "maybe", so what they let through is joined exactly later."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Largest bitmap, as bits: 64 MB.
MOST = 29


def of(df: DataFrame, column: str) -> np.ndarray:
    """Bits of all values of a long column, about 16 a value up to 2**MOST."""
    n = df.count()
    bits = min(max((16 * n).bit_length(), 16), MOST)
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = df.where(F.col(column).isNotNull()).groupBy(F.shiftright(slot, 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int)))").alias("word"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    found = words.toArrow()
    out[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return out


def maybe(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = (len(bitmap) * 64).bit_length() - 1
    slot = h.astype(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
