"""Fixed-size bit filters: prune rows before a shuffle whose join is exact anyway."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bits of a filter; it takes an eighth of this in bytes, however many keys it holds.
BITS = 1 << 26


def build(keys: DataFrame, column: str) -> np.ndarray:
    """The filter of a column of longs.

    Tasks make words of 64 bits, Spark merges them, and the driver gets one row a word at
    most: 16 bytes for each, 16 MB in all.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.asarray(batch.column(0)).view(np.uint64) % np.uint64(BITS)
            yield pa.RecordBatch.from_arrays([pa.array((bit // np.uint64(64)).astype(np.int64)), pa.array((np.uint64(1) << (bit % np.uint64(64))).view(np.int64))], names=["w", "b"])

    merged = keys.where(F.col(column).isNotNull()).select(column).mapInArrow(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(BITS // 64, np.int64)
    for batch in merged.toArrow().to_batches():
        table[np.asarray(batch.column(0))] = np.asarray(batch.column(1))
    return table.view(np.uint64)


def holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter (all that are, and few others)."""
    bit = keys.astype(np.uint64, copy=False) % np.uint64(BITS)
    return (table[(bit // np.uint64(64)).astype(np.int64)] >> (bit % np.uint64(64))) & np.uint64(1) == 1
