"""Event and time-series operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.functions.columns import all_same, micros, text_of
from millrace.functions.ranges import numbered, running

_SECOND = 1_000_000
#: Rows of one order that a rolling statistic takes together.
BLOCK = 8192


def sessionize(df: DataFrame, entity: Sequence[str], ts: str, minutes: float, order: Sequence[str] = ()) -> DataFrame:
    """Add session_id and session_seq (from 1): a session breaks when a gap is longer than ``minutes``."""
    by = Window.partitionBy(*entity).orderBy(ts, *order)
    gap = micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(by)
    opened = F.when(gap > int(minutes * 60 * _SECOND), 1).otherwise(0)
    numbered = df.withColumn("__new", opened).withColumn("__session", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*entity, "__session").orderBy(ts, *order)
    return (
        numbered.withColumn("session_id", F.concat_ws("_", *[text_of(F.col(e)) for e in entity], F.col("__session").cast("string")))
        .withColumn("session_seq", F.row_number().over(within).cast("long"))
        .drop("__new", "__session")
    )


def funnel(df: DataFrame, user: str, event: str, steps: Sequence[str]) -> DataFrame:
    """Users who have all of the first i steps' events in any order, and the rate against the step before.

    One flag a step is aggregated per user, so a user's events are never gathered.
    """
    flags = df.where(F.col(event).isin(list(steps))).groupBy(user).agg(*[F.max((F.col(event) == s).cast("int")).alias(f"s{i}") for i, s in enumerate(steps)])
    reached = [sum((F.col(f"s{k}") for k in range(i + 1)), F.lit(0)) == i + 1 for i in range(len(steps))]
    counts = flags.agg(*[F.count_if(r).alias(f"n{i}") for i, r in enumerate(reached)])
    rows = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("step"), F.lit(s).alias("event"), F.col(f"n{i}").alias("users"), (F.col(f"n{i - 1}") if i else F.lit(None).cast("long")).alias("before")) for i, s in enumerate(steps)])
    return counts.select(F.inline(rows)).select("step", "event", "users", F.when(F.col("before") > 0, F.col("users") / F.col("before")).alias("conversion"))


def cohorts(df: DataFrame, user: str, ts: str, metric: str, days: int = 7, aggregation: str = "count") -> DataFrame:
    """Per cohort (users of one first timestamp) and period since then: users and the metric."""
    first = df.groupBy(user).agg(F.min(ts).alias("first_seen"))
    period = F.floor((micros(F.col(ts)) - micros(F.col("first_seen"))) / (days * 86400 * _SECOND)).cast("long")
    value = {"count": F.count(metric), "sum": F.coalesce(F.sum(metric), F.lit(0)), "mean": F.avg(metric)}[aggregation]
    return (
        df.join(first, user)
        .groupBy("first_seen", period.alias("period"))
        .agg(F.countDistinct(user).alias("users"), value.alias("metric"))
        .select(F.date_format("first_seen", "yyyy-MM-dd").alias("cohort"), "first_seen", "period", "users", "metric")
    )


def resample(df: DataFrame, ts: str, value: str, seconds: int, aggregation: str = "mean", order: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Buckets of whole multiples of ``seconds`` since the epoch; empty buckets are not made."""
    bucket = F.floor(micros(F.col(ts)) / (seconds * _SECOND)) * seconds
    pick = {
        "mean": lambda: F.avg(value),
        "sum": lambda: F.sum(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "count": lambda: F.count(value),
        "first": lambda: F.min_by(value, order or ts),
        "last": lambda: F.max_by(value, order or ts),
    }[aggregation]()
    return df.groupBy(*by, bucket.cast("long").alias("bucket")).agg(pick.alias("value"))


def rolling(df: DataFrame, ts: str, value: str, size: int, statistic: str = "mean", by: Sequence[str] = (), order: Sequence[str] = (), name: str = "rolling") -> DataFrame:
    """Statistic of the last ``size`` rows, fewer at the start; without ``by`` over all rows, in blocks of their order that begin with the rows they need of the one before."""
    pick = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop}[statistic]
    if by:
        return df.withColumn(name, pick(value).over(Window.partitionBy(*by).orderBy(ts, *order).rowsBetween(-(size - 1), 0)))
    block = max(BLOCK, size)
    place = numbered(df, [ts, *order], "__n").withColumn("__n", F.col("__n") - 1)
    at = F.floor(F.col("__n") / block)
    needed = F.when(F.col("__n") % block > block - size, F.array(at, at + 1)).otherwise(F.array(at))
    dealt = place.withColumn("__block", F.explode(needed))
    over = Window.partitionBy("__block").orderBy("__n").rowsBetween(-(size - 1), 0)
    return dealt.withColumn(name, pick(value).over(over)).where(F.col("__block") == at).drop("__n", "__block")


def late_events(df: DataFrame, arrival: str, ts: str, value: str, bucket_seconds: int, lateness_seconds: int, by: Sequence[str] = (), aggregation: str = "sum") -> DataFrame:
    """Events in arrival order with is_late, and one correction row a bucket that a late event reached.

    The watermark is the largest timestamp so far; an event older than it less the
    lateness is late. A correction holds the bucket's sum, count or mean up to its last late event. Null keys are a key.
    Without ``by`` the watermark runs over all rows, by ranges of their arrival.
    """
    t = micros(F.col(ts))
    bucket = (F.floor(t / (bucket_seconds * _SECOND)) * bucket_seconds).cast("long")
    marked = df.withColumn("bucket", bucket).withColumn("__t", t)
    if by:
        so_far = Window.partitionBy(*by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
        marked = marked.withColumn("__mark", F.max("__t").over(so_far))
    else:
        marked = running(marked, [arrival], {"__mark": ("__t", "max")})
    marked = marked.withColumn("is_late", F.col("__t") < F.col("__mark") - lateness_seconds * _SECOND)
    events = marked.select(*by, F.lit("event").alias("kind"), F.col(arrival).alias("arrival"), "bucket", F.col(value).cast("double").alias("value"), "is_late")
    last = events.where("is_late").groupBy(*by, "bucket").agg(F.max("arrival").alias("__last"))
    pick = {"sum": F.sum, "count": F.count, "mean": F.avg}[aggregation]("value").cast("double")
    of_last = all_same("e", "l", [*by, "bucket"]) & (F.col("e.arrival") <= F.col("l.__last"))
    held = events.alias("e").join(last.alias("l"), of_last).select("e.*", "l.__last")
    corrections = held.groupBy(*by, "bucket", "__last").agg(pick.alias("value"))
    return events.union(corrections.select(*by, F.lit("correction"), "__last", "bucket", "value", F.lit(True)))


def windowed_deduplicate(df: DataFrame, keys: Sequence[str], ts: str, minutes: float, order: str) -> DataFrame:
    """Keep an event when the last kept one of its key is ``minutes`` or more before it; equal times in the given order.

    Each key's events arrive sorted and pass once; only the last kept time is held, so a key may have any number of them.
    Null keys are a key of their own; rows without a time go.
    """
    span = int(minutes * 60 * _SECOND)
    rows = df.select("*", F.to_json(F.struct(*keys)).alias("__key"), micros(F.col(ts)).alias("__t")).where("__t IS NOT NULL")
    n = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, t = batch.column(n), np.asarray(batch.column(n + 1))
            new = np.asarray(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).cast(pa.int8()))
            cuts = [0, *(np.flatnonzero(new) + 1), len(key)]
            kept = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                own = key[i].as_py()
                at = i + int(np.searchsorted(t[i:j], last + span)) if own == last_key else i
                while at < j:
                    kept.append(at)
                    last = int(t[at])
                    at = max(at + 1, i + int(np.searchsorted(t[i:j], last + span)))
                last_key = own
            yield batch.select(list(range(n))).take(pa.array(kept, pa.int64()))

    return rows.repartition("__key").sortWithinPartitions("__key", "__t", order).mapInArrow(run, df.schema)
