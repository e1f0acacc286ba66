"""Recursions along an order as associative scans over ranges of it, so that no task sees a whole series.

Each row is an element; elements of neighbouring rows compose, and composing is associative. One sort deals the
rows to ranges. Every range composes its rows to one element, the driver composes those (a row a range, whatever the table's
size), and then every range goes over its rows again from what stands before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.storage import written

Elements = np.ndarray


class Scan(NamedTuple):
    """elements(values, starts): a row of numbers for each row of a table; starts marks first rows of a series, whose
    element depends on nothing before. compose(a, b): a before b, for arrays of elements. outputs(upto, before, values, starts): arrays of
    results from the elements composed up to each row, and up to the row before it."""

    elements: Callable[[list[np.ndarray], np.ndarray], Elements]
    compose: Callable[[Elements, Elements], Elements]
    outputs: Callable[[Elements, Elements, list[np.ndarray], np.ndarray], list[np.ndarray]]


def _segmented(compose: Callable[[Elements, Elements], Elements]) -> Callable[[Elements, Elements], Elements]:
    """Composition of elements whose first column says that a series begins in them."""

    def run(a: Elements, b: Elements) -> Elements:
        out = np.empty_like(b)
        out[:, 1:] = np.where(b[:, :1] > 0, b[:, 1:], compose(a[:, 1:], b[:, 1:]))
        out[:, 0] = np.maximum(a[:, 0], b[:, 0])
        return out

    return run


def _prefixes(e: Elements, compose: Callable[[Elements, Elements], Elements]) -> Elements:
    """Each element composed with all before it, in a number of array operations logarithmic in their number."""
    n = len(e)
    if n < 2:
        return e
    odd = _prefixes(compose(e[: n - 1 : 2], e[1::2]), compose)
    out = np.empty_like(e)
    out[0], out[1::2] = e[0], odd
    out[2::2] = compose(odd[: (n - 1) // 2], e[2::2])
    return out


def _total(e: Elements, compose: Callable[[Elements, Elements], Elements]) -> Elements:
    """All elements composed to one."""
    while len(e) > 1:
        pairs = compose(e[: len(e) - 1 : 2], e[1::2])
        e = np.concatenate([pairs, e[-1:]]) if len(e) % 2 else pairs
    return e


def associative_scan(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], values: Sequence[str], scan: Scan, made: Sequence[str]) -> DataFrame:
    """``df`` with double columns made by a scan along each series.

    by: columns of equal values in a series (none: all rows are one); order: of the rows in it, best without ties, which go in any order.
    Rows in which one of the values is null are left out of the series and get nulls.
    """
    keyed = df.withColumn("__key", F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit(""))
    placed = written(keyed.orderBy("__key", *order).withColumn("__part", F.spark_partition_id()))
    light = placed.select("__part", "__key", *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)])
    light = light.where(" AND ".join(f"__v{i} IS NOT NULL" for i in range(len(values))))
    compose = _segmented(scan.compose)

    def read(batch: pa.RecordBatch, last: str | None) -> tuple[list[np.ndarray], np.ndarray, list[str]]:
        keys = batch.column(1).to_pylist()
        starts = np.array([k != before for k, before in zip(keys, [last, *keys[:-1]], strict=True)])
        return [np.asarray(batch.column(2 + i), np.float64) for i in range(len(values))], starts, keys

    def made_of(columns: list[np.ndarray], starts: np.ndarray) -> Elements:
        return np.column_stack([starts.astype(float), scan.elements(columns, starts)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, heads, rest = None, None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, starts, keys = read(batch, last)
            if part is None:  # whether a series begins with the first row is known when the ranges meet
                part, first = batch.column(0)[0].as_py(), keys[0]
                heads = [made_of([c[:1] for c in columns], np.array([s])) for s in (False, True)]
                columns, starts = [c[1:] for c in columns], starts[1:]
            last = keys[-1]
            if len(starts):
                own = made_of(columns, starts)
                rest = _total(own if rest is None else np.concatenate([rest, own]), compose)
        if part is not None:
            rows = [heads[0], heads[1], rest if rest is not None else np.empty((0, heads[0].shape[1]))]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([last]), *[pa.array([r.ravel().tolist()], pa.list_(pa.float64())) for r in rows]], names=["part", "first", "last", "middle", "start", "rest"])

    found = light.mapInArrow(summed, "part int, first string, last string, middle array<double>, start array<double>, rest array<double>").collect()
    before: dict[int, tuple[str, np.ndarray]] = {}
    held: tuple[str, np.ndarray] | None = None
    for r in sorted(found, key=lambda r: r["part"]):
        goes_on = held is not None and held[0] == r["first"]
        if goes_on:
            before[r["part"]] = held
        own = np.array([r["middle" if goes_on else "start"]])
        own = compose(held[1], own) if goes_on else own
        if r["rest"]:
            own = compose(own, np.array([r["rest"]]))
        own[:, 0] = 0
        held = (r["last"], own)
    sent = df.sparkSession.sparkContext.broadcast(before)
    n = len(df.columns)
    schema = T.StructType([*df.schema.fields, *[T.StructField(m, T.DoubleType()) for m in made]])
    doubles = [F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)]

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for k, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            if last is None and (found := sent.value.get(batch.column(n)[0].as_py())):
                last, state = found
            held = np.ones(batch.num_rows, bool)
            for i in range(len(values)):
                held &= ~np.asarray(batch.column(n + 2 + i).is_null())
            rows = pa.RecordBatch.from_arrays(batch.columns[n:], names=batch.schema.names[n:]).filter(pa.array(held))
            results = [np.zeros(batch.num_rows) for _ in made]
            if rows.num_rows:
                columns, starts, keys = read(rows, last)
                own = made_of(columns, starts)
                if state is not None:
                    own[:1] = compose(state, own[:1])
                upto = _prefixes(own, compose)
                earlier = np.concatenate([state if state is not None else np.zeros_like(own[:1]), upto[:-1]])
                state, last = upto[-1:].copy(), keys[-1]
                state[:, 0] = 0
                for result, x in zip(results, scan.outputs(upto[:, 1:], earlier[:, 1:], columns, starts), strict=True):
                    result[held] = x
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(r, mask=~held) for r in results]], names=schema.names)

    return placed.select(*df.columns, "__part", "__key", *doubles).mapInArrow(replayed, schema)
