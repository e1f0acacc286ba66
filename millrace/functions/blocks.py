"""One order of rows cut to blocks with a look ahead, so that windows along series of any length are arrays of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.ranges import numbered

#: Rows of a block, beside those of its look ahead.
SIZE = 4096

Run = Callable[[list[str], np.ndarray, int, list[np.ndarray]], Iterator[pa.RecordBatch]]


def keyed(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(key, n, v0, v1, ...): rows that have all values, numbered from 1 through all series, one behind the other; key is JSON of the series' columns."""
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    picked = df.select(key.alias("key"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    whole = picked.where(" AND ".join(f"v{i} IS NOT NULL" for i in range(len(values))))
    return numbered(whole, ["key", *[f"o{i}" for i in range(len(order))]], "n").select("key", "n", *[f"v{i}" for i in range(len(values))])


def place(n: Column) -> Column:
    """The block of the row with number ``n``."""
    return F.floor((n - 1) / SIZE)


def gathered(rows: DataFrame, ahead: int, behind: int = 0) -> DataFrame:
    """(block, first, last, r): each block's rows in their order, those of its look ahead and the ``behind`` ones before it included; first and last: the numbers between which its own are."""
    if not 0 <= ahead <= SIZE or not 0 <= behind <= SIZE:
        raise ValueError(f"the look ahead must not exceed {SIZE} rows")
    size, block = SIZE, place(F.col("n"))
    inside = (F.col("n") - 1) % size
    to = F.when((inside < ahead) & (block > 0), F.array(block - 1, block)).otherwise(F.array(block))
    if behind:
        to = F.when(inside >= size - behind, F.concat(to, F.array(block + 1))).otherwise(to)
    names = [c for c in rows.columns if c not in ("key", "n")]
    copied = rows.withColumn("block", F.explode(to))
    sorted_rows = F.sort_array(F.collect_list(F.struct("n", "key", *names))).alias("r")
    return copied.groupBy("block").agg(sorted_rows).select("block", (F.col("block") * size + 1).alias("first"), ((F.col("block") + 1) * size).alias("last"), "r")


def series_ends(keys: list[str]) -> np.ndarray:
    """Where the series of each row ends."""
    same = np.array([x == y for x, y in zip(keys, keys[1:], strict=False)], bool)
    last = np.r_[np.flatnonzero(~same) + 1, len(keys)]
    return last[np.searchsorted(last, np.arange(len(keys)), side="right")]


def each_block(rows: DataFrame, ahead: int, schema: str, run: Run) -> DataFrame:
    """Rows of ``run(keys, ends, own, values)`` for each block of ``keyed`` rows.

    keys: of each row; ends: where each row's series ends in the block; own: rows that are the block's, behind which those of the look ahead
    stand, which begin the next block. A block holds parts of many short series or of one long one.
    """
    names = [c for c in rows.columns if c not in ("key", "n")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for last, n, keys, *values in zip(*[batch.column(i) for i in range(batch.num_columns)], strict=True):
                keys = keys.values.to_pylist()
                own = int((np.asarray(n.values) <= last.as_py()).sum())
                yield from run(keys, series_ends(keys), own, [np.asarray(v.values, np.float64) for v in values])

    return gathered(rows, ahead).select("last", "r.n", "r.key", *[f"r.{c}" for c in names]).mapInArrow(each, schema)
