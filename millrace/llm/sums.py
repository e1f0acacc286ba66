"""Running sums over many cells, in two levels so that no task holds all of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def sums_before(cells: DataFrame, by: list[str], place: str, value: str, width: int) -> DataFrame:
    """``cells`` with ``base``: the sum of ``value`` over the cells of equal ``by`` at smaller places.

    cells: one row for each ``by`` and place; places: whole numbers from 0 to below ``width``.
    Places are summed in stretches of about sqrt(width) first, then the stretches, then the places inside each.
    """
    stretched = cells.withColumn("stretch", F.floor(F.col(place) / max(1, math.isqrt(width))).cast("int"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = stretched.groupBy(*by, "stretch").agg(F.sum(value).alias("m"))
    before = whole.select(*by, "stretch", F.coalesce(F.sum("m").over(earlier(Window.partitionBy(*by).orderBy("stretch"))), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy(*by, "stretch").orderBy(place))), F.lit(0))
    return (
        stretched.withColumn("inside", inside)
        .join(before.hint("merge"), [*by, "stretch"])
        .select(*cells.columns, (F.col("before") + F.col("inside")).alias("base"))
    )
