"""Fixed-size bit filters for 64-bit keys: a first test inside map tasks before an exact join."""

from __future__ import annotations

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24


def bit_filter(keys: DataFrame, key: str | Column, bits: int = BITS) -> Broadcast:
    """Broadcast bitmap of the low ``bits`` bits of a long column.

    Rows brought to the driver: at most 2**bits / 64 (262,144 words of 8 bytes for 24 bits), whatever the number of keys. More keys make the
    filter pass more rows, never fewer, so results don't depend on it.
    """
    slot = F.col(key) if isinstance(key, str) else key
    slot = slot.bitwiseAND(F.lit((1 << bits) - 1))
    cells = keys.select(F.shiftright(slot, 6).cast("int").alias("cell"), F.expr("shiftleft(1L, cast(0 as int))").alias("one"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    cells = cells.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("word")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[cells["cell"].to_numpy(np.int64)] = cells["word"].to_numpy(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit keys the bitmap may hold."""
    slot = keys & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
