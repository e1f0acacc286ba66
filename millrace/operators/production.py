"""Well, production and integrity tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Rows of one task that looks up values of a table.
PART = 100_000


def gas_oil_ratio(gas: Column, oil: Column) -> Column:
    return gas / (oil + 1e-6)


def standard_rate(rate: Column, pressure: Column, temperature_f: Column, reference_pressure: float, reference_temperature_f: float) -> Column:
    """A rate at reference pressure and temperature (Fahrenheit)."""
    return rate * (pressure / reference_pressure) * ((reference_temperature_f + 459.67) / (temperature_f + 459.67))


def forecast(wells: DataFrame, well: str, rate: str, decline: str, exponent: str, months: int) -> DataFrame:
    """Rates of the months to come by Arps' decline: exponential at exponent 0, hyperbolic above."""
    t = F.col("month") / 12
    b, d = F.col(exponent), F.col(decline)
    q = F.when(b == 0, F.col(rate) * F.exp(-d * t)).otherwise(F.col(rate) / F.pow(1 + b * d * t, 1 / F.when(b == 0, 1.0).otherwise(b)))
    return wells.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(months)))).select(well, "month", q.alias("rate"))


def downtimes(df: DataFrame, by: Sequence[str], at: str, hours: float) -> DataFrame:
    """Gaps between readings that are longer than ``hours``: start, end and their length in hours."""
    before = F.lag(at).over(Window.partitionBy(*by).orderBy(at))
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 3.6e9
    return df.withColumn("start", before).withColumn("hours", gap).where(F.col("hours") > hours).select(*by, "start", F.col(at).alias("end"), "hours")


def corrosion_rates(before: DataFrame, after: DataFrame, feature: str, depth: str, years: float) -> DataFrame:
    """Growth of each feature's depth a year; features seen once only have none."""
    a = before.select(feature, F.col(depth).alias("__a"))
    return after.join(a, feature).select(feature, ((F.col(depth) - F.col("__a")) / years).alias("rate"))


def inspection_risk(rate: Column, consequence: Column, worst: float = 10.0) -> Column:
    return F.least(rate / worst, F.lit(1.0)) * consequence


def emissions(events: DataFrame, factors: DataFrame, source: str, volume: str, density: float) -> DataFrame:
    """CO2-equivalent mass per source; factors: (source, factor), 1 for unknown sources."""
    f = factors.select(F.col("source").alias("__s"), F.col("factor").alias("__f")).dropDuplicates(["__s"])
    mass = F.col(volume) * F.coalesce("__f", F.lit(1.0)) * density
    return events.join(f, F.col(source) == F.col("__s"), "left").groupBy(source).agg(F.sum(mass).alias("co2e"), F.count(F.lit(1)).alias("events"))


def coverage(df: DataFrame, by: Sequence[str], potential: str, threshold: float) -> DataFrame:
    """Share of potentials below the protection threshold, 0 without readings."""
    return df.groupBy(*by).agg(F.coalesce(F.avg((F.col(potential) < threshold).cast("double")), F.lit(0.0)).alias("coverage"))


def shale_volume(gamma: Column, clean: float, shale: float, method: str = "linear") -> Column:
    """Volume of shale from a gamma-ray reading, kept within 0 and 1."""
    index = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (gamma - clean) / (shale - clean)))
    return {
        "linear": index,
        "larionov_older": 0.33 * (F.pow(F.lit(2.0), 2 * index) - 1),
        "larionov_tertiary": 0.083 * (F.pow(F.lit(2.0), 3.7 * index) - 1),
        "clavier": 1.7 - F.sqrt(3.38 - F.pow(index + 0.7, F.lit(2.0))),
        "steiber": index / (3 - 2 * index),
    }[method]


def density_porosity(bulk: Column, matrix: float, fluid: float) -> Column:
    return (matrix - bulk) / (matrix - fluid)


def water_saturation(resistivity: Column, porosity: Column, water_resistivity: float, a: float = 1.0, m: float = 2.0, n: float = 2.0) -> Column:
    """Archie's saturation, at most 1."""
    return F.least(F.lit(1.0), F.pow(a * water_resistivity / (F.pow(porosity, F.lit(m)) * resistivity), F.lit(1 / n)))


def well_path(survey: DataFrame, by: Sequence[str], depth: str, inclination: str, azimuth: str) -> DataFrame:
    """North, east and true vertical depth by minimum curvature; angles in degrees."""
    order = Window.partitionBy(*by).orderBy(depth)
    i, a = F.radians(inclination), F.radians(azimuth)
    i0, a0, length = F.lag(i, 1).over(order), F.lag(a, 1).over(order), F.col(depth) - F.lag(depth).over(order)
    bend = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(F.col("__i") - F.col("__i0")) - F.sin("__i0") * F.sin("__i") * (1 - F.cos(F.col("__a") - F.col("__a0"))))))
    stations = survey.withColumns({"__i": i, "__a": a, "__i0": i0, "__a0": a0, "__l": length}).withColumn("__b", bend)
    factor = F.when(F.col("__b") < 1e-9, 1.0).otherwise(2 / F.col("__b") * F.tan(F.col("__b") / 2)) * F.col("__l") / 2
    steps = {"north": F.sin("__i0") * F.cos("__a0") + F.sin("__i") * F.cos("__a"), "east": F.sin("__i0") * F.sin("__a0") + F.sin("__i") * F.sin("__a"), "tvd": F.cos("__i0") + F.cos("__i")}
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    out = stations.withColumns({n: F.coalesce(F.sum(factor * s).over(so_far), F.lit(0.0)) for n, s in steps.items()})
    return out.drop("__i", "__a", "__i0", "__a0", "__l", "__b")


def oil_in_place(acres: Column, thickness_ft: Column, porosity: Column, saturation: Column, volume_factor: Column) -> Column:
    """Original oil in place by volumes, in stock-tank barrels."""
    return 7758.0 * acres * thickness_ft * porosity * (1 - saturation) / volume_factor


def material_balance(oil: Column, water: Column, gas: Column, factor: Column, first_factor: Column, expansion: float = 0.003) -> tuple[Column, Column]:
    """(oil, gas) in place: voidage over the expansion of oil, and gas over its expansion; no expansion of oil: five times what was produced."""
    grown = factor - first_factor
    return F.when(grown > 1e-6, (oil * factor + water) / (grown + 1e-9)).otherwise(oil * 5.0), gas / (expansion + 1e-9)


def interpolated(df: DataFrame, by: Sequence[str], at: str, table: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """Add the table's value at ``at`` by linear interpolation within ``by`` (a fluid's PVT table); outside its range the end's value.

    Table rows and asked rows are ordered together once; nothing is joined pair by pair. A table row knows its next one, so each asked row
    only looks back. Asked rows are dealt to parts of some ``PART``, and each part gets the table, as long as its copies are no more than the asked rows.
    """
    kinds = {c: df.schema[c].dataType for c in df.columns}
    n, n_known = df.count(), max(table.count(), 1)
    parts = max(1, min(math.ceil(n / PART), n // n_known))
    # By a hash, so that a task that runs again deals its rows alike.
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    part = F.pmod(F.xxhash64(*plain, F.lit(7)), F.lit(parts)).cast("int")
    point = F.struct(F.col("__x").alias("x"), F.col("__y").alias("y"))
    known = table.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__y IS NOT NULL")
    known = known.withColumn("__p", F.struct(point.alias("a"), F.lead(point).over(Window.partitionBy(*by).orderBy("__x", "__y")).alias("b")))
    copied = known.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = df.select(F.struct(*df.columns).alias("__row"), *by, part.alias("__part"), F.col(at).cast("double").alias("__x"))
    order = Window.partitionBy(*by, "__part").orderBy("__x", F.col("__p").isNull(), "__y")
    back = F.last("__p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    least = F.first("__p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = asked.unionByName(copied, allowMissingColumns=True).withColumn("__back", back).withColumn("__least", least).where("__row IS NOT NULL")
    a = F.col("__back.a")
    b = F.when(a.isNull(), F.col("__least.a")).otherwise(F.col("__back.b"))
    between = F.when(b.isNull(), a["y"]).when(a.isNull(), b["y"]).when(b["x"] == a["x"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col("__x") - a["x"]) / (b["x"] - a["x"]))
    return met.select(*[F.col(f"__row.{c}").alias(c) for c in kinds], between.alias(name))


def is_shale(gamma: Column, clean: float = 20.0, shale: float = 120.0, cutoff: float = 0.35) -> Column:
    """1.0 where the linear shale volume of a gamma-ray reading exceeds the cutoff (shale), else 0.0 (sand)."""
    volume = F.least(F.greatest((gamma - clean) / (shale - clean), F.lit(0.0)), F.lit(1.0))
    return (volume > cutoff).cast("double")
