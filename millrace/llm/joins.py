"""Joins of many rows with one row a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import fixed_filter

#: Largest table that is sent whole to every executor.
BROADCAST_BYTES = 8 << 20


def is_small(groups: DataFrame, row_bytes: int, counted: int | None = None) -> bool:
    """Whether a stored table's rows stay below ``BROADCAST_BYTES``; they are counted here unless ``counted`` has them."""
    most = BROADCAST_BYTES // row_bytes
    return (groups.limit(most + 1).count() if counted is None else counted) <= most


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], row_bytes: int, how: str = "left", counted: int | None = None) -> DataFrame:
    """Join each row with its group's row.

    groups: a stored table of one row a group; counted: its rows, or a bound of them, where known.  It is broadcast only when its counted rows at
    ``row_bytes`` each stay below ``BROADCAST_BYTES``; beyond that both sides are
    shuffled by the key and adaptive execution splits hot groups, as the
    groups' side has a single row for each.
    """
    if how in ("left_semi", "left_anti"):
        groups = groups.select(*on)
    return rows.join(F.broadcast(groups) if is_small(groups, row_bytes, counted) else groups.hint("merge"), on, how)


def join_rare(rows: DataFrame, found: DataFrame, on: list[str], row_bytes: int) -> DataFrame:
    """Left join of wide rows, few of which have a partner in a stored table of one row a key.

    Where ``found`` is too large to be sent to every executor, a filter of its first key column (a long) parts the rows: those
    that surely have no partner stay where they are, and only the others are shuffled.
    """
    if is_small(found, row_bytes):
        return rows.join(F.broadcast(found), on, "left")
    sent = rows.sparkSession.sparkContext.broadcast(fixed_filter.build(found, on[0]))
    at = rows.columns.index(on[0])

    def parted(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(at)
                maybe = fixed_filter.holds(sent.value, np.asarray(keys.fill_null(0)).view(np.uint64)) & ~np.asarray(keys.is_null())
                yield batch.filter(pa.array(maybe == wanted))

        return rows.mapInArrow(run, rows.schema)

    more = [f for f in found.schema.fields if f.name not in on]
    alone = parted(False).select(*[F.col(c) for c in on], *[c for c in rows.columns if c not in on], *[F.lit(None).cast(f.dataType).alias(f.name) for f in more])
    return alone.unionByName(parted(True).join(found.hint("merge"), on, "left"))
