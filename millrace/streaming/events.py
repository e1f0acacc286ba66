"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.functions.columns import micros
from millrace.operators.warehouse import apply_changes
from millrace.sources.snapshots import SnapshotTable


def resample_stream(df: DataFrame, ts: str, value: str, every: str, lateness: str, by: Sequence[str] = ()) -> DataFrame:
    """Tumbling windows with a watermark: count, sum and mean."""
    window = F.window(ts, every)
    out = df.withWatermark(ts, lateness).groupBy(window, *by).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "sum", "mean")


def session_stream(df: DataFrame, ts: str, entity: Sequence[str], gap: str, lateness: str) -> DataFrame:
    """Sessions by inactivity gap."""
    out = df.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), *entity).agg(F.count(F.lit(1)).alias("events"))
    return out.select(*entity, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def deduplicate_stream(df: DataFrame, keys: Sequence[str], ts: str, within: str) -> DataFrame:
    """Drop repeats that come within a time of the first; the state is bounded by the watermark."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def apply_each_batch(df: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run a batch function on every micro-batch; once: all that is there, then stop."""
    writer = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def changes_into_table(changes: DataFrame, table: SnapshotTable, keys: Sequence[str], values: Sequence[str], checkpoint: str, offset: str = "offset") -> StreamingQuery:
    """Keep a snapshot table up to date with a stream of change events.

    A batch is committed with its number in the log, and one that is there already is
    not applied again, so a restarted query repeats nothing. Only the folders that hold a changed key are rewritten: give the table buckets by
    its keys, and a batch costs what it touches.
    """

    def run(batch: DataFrame, number: int) -> None:
        if any(e.get("batch") == number for e in table.history()):
            return
        changes = batch.persist()
        try:
            none = changes.select(*keys, *values).limit(0)
            make = lambda known: apply_changes(none if known is None else known.select(*keys, *values), changes, keys, values, offset)
            table.rewrite(changes, keys, make, "changes", datetime.now(UTC).isoformat(), {"batch": number})
        finally:
            changes.unpersist()

    return apply_each_batch(changes, run, checkpoint)


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes each batch into a folder of its own below ``path``: one that is run again replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


#: Spark's state store that holds states of several variables on disk.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LateEvents(StatefulProcessor):
    """Running watermark and buckets of one key."""

    def __init__(self, columns: Sequence[str], seconds: int, lateness: int, aggregation: str, retain: int | None):
        self.columns, self.width, self.lateness, self.aggregation, self.retain = list(columns), seconds, lateness * 1_000_000, aggregation, retain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "mark long")
        self.buckets = handle.getMapState("buckets", "bucket long", "n long, total double")

    def _value(self, n: int, total: float) -> float | None:
        if self.aggregation == "count":
            return float(n)
        return None if not n else total if self.aggregation == "sum" else total / n

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True).sort_values("arrival", kind="stable").reset_index(drop=True)
        timed = given["t"].notna().to_numpy()
        t = given["t"].fillna(0).to_numpy(np.int64)
        known = self.mark.get()
        before = known[0] if known else np.iinfo(np.int64).min
        mark = np.maximum(np.maximum.accumulate(np.where(timed, t, before)), before)
        if known or timed.any():
            self.mark.update((int(mark[-1]),))
        late = timed & (t < np.maximum(mark, np.iinfo(np.int64).min + self.lateness) - self.lateness)
        bucket = np.floor_divide(t, self.width * 1_000_000) * self.width
        there = given["value"].notna().to_numpy()
        amounts = given["value"].fillna(0).to_numpy(np.float64)
        # The rows of each bucket, in their order.
        at = np.flatnonzero(timed)
        at = at[np.argsort(bucket[at], kind="stable")]
        ends, values = [], []
        for own in np.split(at, np.flatnonzero(np.diff(bucket[at])) + 1) if len(at) else []:
            k = (int(bucket[own[0]]),)
            # Every timed row sets the mark, so a key without one has no buckets to ask for.
            held = self.buckets.getValue(k) if known else None
            if self.retain is not None and not held:
                self.handle.registerTimer((k[0] + self.width + self.retain) * 1000)
            n, total = held or (0, 0.0)
            numbers, totals = n + np.cumsum(there[own]), total + np.cumsum(amounts[own])
            self.buckets.updateValue(k, (int(numbers[-1]), float(totals[-1])))
            if (last := np.flatnonzero(late[own])).size:
                ends.append(own[last[-1]])
                values.append(self._value(int(numbers[last[-1]]), float(totals[last[-1]])))
        named = dict(zip(self.columns, key, strict=True))
        yield pd.DataFrame(named | {"kind": "event", "arrival": given["arrival"], "bucket": pd.arrays.IntegerArray(bucket, ~timed), "value": given["value"], "is_late": pd.arrays.BooleanArray(late, ~timed)}, copy=False)
        if ends:
            yield pd.DataFrame(named | {"kind": "correction", "arrival": given["arrival"].take(ends).array, "bucket": bucket[ends], "value": np.array(values, np.float64), "is_late": True})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Forget buckets that the watermark has left behind by the time they are kept."""
        done = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.width - self.retain
        if self.buckets.containsKey((done,)):
            self.buckets.removeKey((done,))
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def late_events_stream(df: DataFrame, arrival: str, ts: str, value: str, bucket_seconds: int, lateness_seconds: int, by: Sequence[str], aggregation: str = "sum", retain_seconds: int | None = None) -> DataFrame:
    """``timeseries.late_events`` over a stream: every event with is_late, and a correction row for each bucket that a batch's late events reach.

    A bucket's correction stands for it up to the batch's last late event and replaces the earlier ones: those of the largest arrival
    are the rows of the batch operator. Each key holds the largest time seen and a count and sum per bucket, in the state store. Arrivals must rise
    from batch to batch. retain_seconds: buckets end so long after the stream's own watermark, by timers, and rows older than that
    are dropped; none: all are kept. The session's state store is set to the one that holds such states (``ROCKS``).
    """
    if aggregation not in ("sum", "count", "mean") or not by:
        raise ValueError("the aggregation is sum, count or mean, by one column or more")
    conf = df.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = df if retain_seconds is None else df.withWatermark(ts, f"{retain_seconds} seconds")
    # Spark wants the watermark's own column on the way to the timers.
    marked = [] if retain_seconds is None else [F.col(ts).alias("__ts")]
    light = rows.select(*by, F.col(arrival).alias("arrival"), micros(F.col(ts)).alias("t"), F.col(value).cast("double").alias("value"), *marked)
    types = {f.name: f.dataType for f in light.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in by])
    for name, kind in (("kind", T.StringType()), ("arrival", types["arrival"]), ("bucket", T.LongType()), ("value", T.DoubleType()), ("is_late", T.BooleanType())):
        schema.add(name, kind)
    processor = _LateEvents(by, bucket_seconds, lateness_seconds, aggregation, retain_seconds)
    return light.groupBy(*by).transformWithStateInPandas(processor, schema, "append", "None" if retain_seconds is None else "EventTime")
