"""Running values over one global order, made by ranges of it so that no task holds all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.functions.storage import written

_KINDS = {"sum": F.sum, "max": F.max}


def running(df: DataFrame, order: Sequence[str | Column], values: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``df`` with running sums or maxima over all rows in an order, the own row included.

    Rows of equal place stand in an order of their hashes. values: new column to (column, "sum" or "max"). Spark's sort deals the order to ranges; they are
    summed first (one row a range), then each inside. The sorted rows are written once, as both steps must see the same ranges.
    """
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    # Rows of equal place differ in their hashes, so many of them are dealt to several ranges.
    ties = [F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in plain])] if plain else []
    placed = written(df.orderBy(*order, *ties).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    whole = placed.groupBy("__part").agg(*[_KINDS[kind](column).alias(f"__v_{name}") for name, (column, kind) in values.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("__part", *[_KINDS[kind](f"__v_{name}").over(earlier).alias(f"__b_{name}") for name, (_, kind) in values.items()])
    inside = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    made = {}
    for name, (column, kind) in values.items():
        own, base = _KINDS[kind](column).over(inside), F.col(f"__b_{name}")
        made[name] = F.coalesce(own + base, own, base) if kind == "sum" else F.greatest(own, base)
    return placed.join(F.broadcast(before), "__part").select(*df.columns, *[c.alias(n) for n, c in made.items()])


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with the number of each row in an order, from 1."""
    return running(df.withColumn("__one", F.lit(1).cast("long")), order, {name: ("__one", "sum")}).drop("__one")


def quantiles(df: DataFrame, by: str, value: str, ranks: Mapping[str, float]) -> DataFrame:
    """(by, one column a rank): exact quantiles with linear interpolation, from counts of distinct values in ranges."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by), F.col(value)).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(counts, [by, value], {"__upto": ("__n", "sum")})
    bounds = upto.groupBy(by).agg(F.min(F.col("__upto") - F.col("__n")).alias("__start"), F.sum("__n").alias("__total"))
    joined = upto.join(F.broadcast(bounds), by)
    place = {n: F.lit(r) * (F.col("__total") - 1) for n, r in ranks.items()}
    at = lambda i: F.min(F.when(F.col("__upto") - F.col("__start") > i, F.col(value)))
    ends = joined.groupBy(by, "__total").agg(*[x for n, p in place.items() for x in (at(F.floor(p)).alias(f"__l_{n}"), at(F.ceil(p)).alias(f"__h_{n}"))])
    between = {n: F.col(f"__l_{n}") + (p - F.floor(p)) * (F.col(f"__h_{n}") - F.col(f"__l_{n}")) for n, p in place.items()}
    return ends.select(by, *[c.alias(n) for n, c in between.items()])
