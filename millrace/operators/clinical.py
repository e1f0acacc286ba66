"""Clinical, trial and wearable tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

# Fixed value: the shape of an ICD-10 code.
ICD10 = r"^[A-TV-Z][0-9][0-9AB]\.?[0-9A-TV-Z]{0,4}$"


def vital_summary(df: DataFrame, patient: str, vital: str, value: str, order: str) -> DataFrame:
    """Mean, least, largest, last and number of each patient's readings of a vital sign."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(patient, vital).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest"), F.max_by(value, order).alias("last"), F.count(value).alias("n"))


def code_category(code: Column, length: int = 3) -> Column:
    """A diagnosis code rolled up to its first characters before the point."""
    return F.substring(F.split(code, r"\.")[0], 1, length)


def all_valid(codes: Column, pattern: str = ICD10) -> Column:
    """Whether every code of an array has the shape of one."""
    return F.forall(codes, lambda c: c.rlike(pattern))


def convert_units(df: DataFrame, units: DataFrame, value: str, unit: str, target: str) -> DataFrame:
    """Values in the target unit; units: (from_unit, to_unit, factor), an unknown pair keeps its value."""
    known = units.where(F.col("to_unit") == target).select(F.col("from_unit").alias("__u"), F.col("factor").cast("double").alias("__f")).dropDuplicates(["__u"])
    joined = df.join(known, F.col(unit) == F.col("__u"), "left")
    return joined.withColumns({value: F.col(value) * F.coalesce("__f", F.lit(1.0)), unit: F.lit(target)}).drop("__u", "__f")


def timeline(df: DataFrame, patient: str, at: str, order: Sequence[str] = ()) -> DataFrame:
    """Number of each encounter of a patient, and days since the first and the one before."""
    by = Window.partitionBy(patient).orderBy(at, *order)
    days = lambda a, b: F.datediff(F.col(a) if isinstance(a, str) else a, b)
    return df.withColumns({"encounter": F.row_number().over(by).cast("long"), "days_since_first": days(at, F.min(at).over(Window.partitionBy(patient))), "days_since_last": days(at, F.lag(at).over(by))})


def pseudonym(identity: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt + "|"), identity.cast("string")), 256), 1, 16)


def event_counts(df: DataFrame, subject: str, code: str, codes: Sequence[str]) -> DataFrame:
    """One column a code with its count per subject; subjects without any of them are left out."""
    counts = [F.count_if(F.col(code) == c).alias(c) for c in codes]
    return df.where(F.col(code).isin(list(codes))).groupBy(subject).agg(*counts)


def treatment_emergent(events: DataFrame, exposures: DataFrame, subject: str, at: str, exposed_at: str) -> DataFrame:
    """Mark events on or after the subject's first exposure; no exposure, no mark."""
    first = exposures.groupBy(subject).agg(F.min(exposed_at).alias("__first"))
    return events.join(first, subject, "left").withColumn("is_emergent", F.coalesce(F.col(at) >= F.col("__first"), F.lit(False))).drop("__first")


def risk_by_arm(df: DataFrame, arm: str, outcome: str, adherent: str | None = None) -> DataFrame:
    """Mean outcome per arm, of all (intention to treat) or of adherent subjects (per protocol)."""
    kept = df.where(adherent) if adherent else df
    return kept.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(outcome).cast("double")).alias("risk"))


def without_intercurrent(df: DataFrame, codes: str, events: Sequence[str]) -> DataFrame:
    """Records free of intercurrent events (an estimand's while-on-treatment form)."""
    return df.where(~F.arrays_overlap(codes, F.array(*map(F.lit, events))))


def heart_rate_variability(df: DataFrame, by: Sequence[str], order: str, interval: str) -> DataFrame:
    """SDNN, RMSSD, share of neighbours over 50 ms apart, and mean rate from intervals in ms."""
    step = F.col(interval) - F.lag(interval).over(Window.partitionBy(*by).orderBy(order))
    return (
        df.withColumn("__d", step)
        .groupBy(*by)
        .agg(F.stddev_samp(interval).alias("sdnn"), F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias("rmssd"), F.avg((F.abs("__d") > 50).cast("double")).alias("pnn50"), (60000 / F.avg(interval)).alias("rate"))
    )


def time_in_range(df: DataFrame, by: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    share = lambda c: 100 * F.avg(c.cast("double"))
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), share(v.between(low, high)).alias("in_range"), share(v < low).alias("below"), share(v > high).alias("above"))


def hl7_fields(message: Column) -> Column:
    """An HL7 v2 message as an array of (segment, fields)."""
    lines = F.filter(F.split(message, r"[\r\n]+"), lambda s: F.length(s) > 0)
    return F.transform(lines, lambda s: F.struct(F.split(s, r"\|")[0].alias("segment"), F.split(s, r"\|").alias("fields")))


def reconciled_medications(df: DataFrame, by: Sequence[str], drug: str, codes: DataFrame, name: str, code: str) -> DataFrame:
    """(by, code) of each patient's drugs, each code once; names meet the code table without regard to case and outer blanks, unknown ones go."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    known = codes.select(key(name).alias("__name"), F.col(code).alias("code")).distinct()
    return df.select(*by, key(drug).alias("__name")).join(known, "__name").select(*by, "code").distinct()


def readmission_risk(df: DataFrame, patient: str, codes: str) -> DataFrame:
    """A patient's largest number of codes in one record, over ten, 1 at most."""
    return df.groupBy(patient).agg(F.least(F.lit(1.0), F.max(F.coalesce(F.size(codes), F.lit(0))) / 10).alias("risk"))


def spirometry(df: DataFrame, by: Sequence[str], order: str, flow: str, rate: float) -> DataFrame:
    """fvc, fev1, their ratio and peak flow of each trace; volume is the running sum of flow over the sample rate."""
    at = Window.partitionBy(*by).orderBy(order)
    volume = df.withColumn("__v", F.sum(flow).over(at.rowsBetween(Window.unboundedPreceding, 0)) / rate).withColumn("__i", F.row_number().over(at))
    second = F.max_by("__v", F.when(F.col("__i") <= int(rate), F.col("__i")))
    made = volume.groupBy(*by).agg(F.max("__v").alias("fvc"), second.alias("fev1"), F.max(flow).alias("pef"))
    return made.withColumn("fev1_fvc_ratio", F.when(F.col("fvc") > 0, F.col("fev1") / F.col("fvc")).otherwise(0.0))


def eligible(df: DataFrame, include: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """``df`` with eligible and failed (numbers of the criteria not met, from 0): all of include and none of exclude must hold; unknown counts as not met."""
    met = [F.coalesce(F.expr(x), F.lit(False)) for x in include] + [~F.coalesce(F.expr(x), F.lit(True)) for x in exclude]
    failed = F.array_compact(F.array(*[F.when(~m, F.lit(i)) for i, m in enumerate(met)]))
    return df.withColumn("failed", failed).withColumn("eligible", F.size("failed") == 0)


def matched_controls(treated: DataFrame, controls: DataFrame, ids: str, score: str, caliper: float) -> DataFrame:
    """(id, control_id, distance): the nearest control of each treated row within a caliper of the score, controls used again; ties by id.

    An equi-join on cells of the caliper's width and their neighbours.
    """
    cell = F.floor(F.col(score) / caliper).cast("long")
    left = treated.select(F.col(ids).alias("id"), F.col(score).alias("s"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("c"))
    right = controls.select(F.col(ids).alias("control_id"), F.col(score).alias("t"), cell.alias("c"))
    near = left.join(right, "c").withColumn("distance", F.abs(F.col("s") - F.col("t"))).where(F.col("distance") <= caliper)
    return near.groupBy("id").agg(F.min(F.struct("distance", "control_id")).alias("b")).select("id", "b.control_id", "b.distance")
