"""Data-quality reports: one pass of aggregates each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.functions.columns import micros, row_digest
from millrace.functions.ranges import quantiles


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: observed, nulls, distinct values, least, largest, most frequent (the least of several), as text."""
    made = []
    for i, c in enumerate(columns):
        made += [F.count(c).alias(f"o{i}"), F.count_if(F.col(c).isNull()).alias(f"n{i}"), F.countDistinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"z{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"o{i}").alias("observed"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct_values"), F.col(f"a{i}").alias("least"), F.col(f"z{i}").alias("largest")) for i, c in enumerate(columns)])
    return df.agg(*made).select(F.inline(rows))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def statistics(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation (0 for one value) and percentiles; exact ones come from counts of values in ranges, exact=False takes sketches."""
    ranks = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))).where("value IS NOT NULL")
    sketched = [] if exact else [F.percentile_approx("value", r, 10_000).alias(n) for n, r in ranks.items()]
    moments = long.groupBy("name").agg(
        F.count("value").alias("n"),
        F.min("value").alias("least"),
        F.max("value").alias("largest"),
        F.avg("value").alias("mean"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).otherwise(0.0).alias("std"),
        *sketched,
    )
    return moments.join(quantiles(long, "name", "value", ranks), "name") if exact else moments


def null_rates(df: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """(column, rate, threshold, passed); an empty table has a rate of 0."""
    made = df.agg(*[F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias(f"r{i}") for i, c in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("rate"), F.lit(float(t)).alias("threshold"), (F.col(f"r{i}") <= float(t)).alias("passed")) for i, (c, t) in enumerate(thresholds.items())])
    return made.select(F.inline(rows))


def row_count(df: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    n = F.count(F.lit(1))
    passed = (n >= least) & (n <= most if most is not None else F.lit(True))
    return df.agg(n.alias("rows"), passed.alias("passed"))


def freshness(df: DataFrame, ts: str, max_age_seconds: float, now: Column) -> DataFrame:
    """(newest, age_seconds, passed); no rows: not passed."""
    age = (micros(now) - micros(F.max(ts))) / 1_000_000
    return df.agg(F.max(ts).alias("newest"), age.alias("age_seconds"), F.coalesce(age <= max_age_seconds, F.lit(False)).alias("passed"))


def schema_diff(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """(column, change, expected, actual): added, dropped and retyped columns."""
    actual = dict(df.dtypes)
    rows = [(c, "added", None, t) for c, t in actual.items() if c not in expected]
    rows += [(c, "dropped", t, None) for c, t in expected.items() if c not in actual]
    rows += [(c, "retyped", t, actual[c]) for c, t in expected.items() if c in actual and actual[c] != t]
    return df.sparkSession.createDataFrame(rows, "column string, change string, expected string, actual string")


def orphans(facts: DataFrame, fact_column: str, dimension: DataFrame, dimension_column: str) -> DataFrame:
    """Fact rows under NOT IN: none if the dimension holds a null, and null keys are never orphans."""
    keys = dimension.select(F.col(dimension_column).alias("__k"))
    if not keys.where("__k IS NULL").isEmpty():
        return facts.limit(0)
    return facts.where(F.col(fact_column).isNotNull()).join(keys.distinct(), F.col(fact_column) == F.col("__k"), "left_anti")


def reconcile(source: DataFrame, target: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each key with its class: added (source only), removed (target only), changed or matched."""
    side = lambda df, n: df.select(*[F.col(k).alias(f"{n}_{k}") for k in keys], row_digest(values).alias(f"{n}__h"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"s_{k}").eqNullSafe(F.col(f"t_{k}"))
    kind = F.when(F.col("t__h").isNull(), "added").when(F.col("s__h").isNull(), "removed").when(F.col("s__h") != F.col("t__h"), "changed").otherwise("matched")
    return side(source, "s").join(side(target, "t"), condition, "full").select(*[F.coalesce(f"s_{k}", f"t_{k}").alias(k) for k in keys], kind.alias("change"))


def count_anomaly(history: DataFrame, order: str, count: str, window: int, threshold: float) -> DataFrame:
    """Each run's count against the mean of up to ``window`` runs before it (history is one row a run)."""
    mean = F.avg(count).over(Window.orderBy(order).rowsBetween(-window, -1))
    deviation = F.abs(F.col(count) - mean) / F.nullif(mean, F.lit(0.0))
    return history.select(order, count, mean.alias("expected"), deviation.alias("deviation"), F.coalesce(deviation > threshold, F.lit(False)).alias("is_anomaly"))
