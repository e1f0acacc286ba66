"""Calculations of clinical, production and signal tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window


def survival_curve(df: DataFrame, time: str, event: str, by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Product-limit estimate, a factor a row in time order: at_risk and survival after each row."""
    over = Window.partitionBy(*by)
    up = over.orderBy(time, *order).rowsBetween(Window.unboundedPreceding, 0)
    at_risk = F.count(F.lit(1)).over(over) - F.row_number().over(over.orderBy(time, *order)) + 1
    ranked = df.withColumn("at_risk", at_risk.cast("long"))
    factor = 1 - F.col(event).cast("int") / F.col("at_risk")
    # A factor of 0 (the last subject has the event) stays 0 from there on.
    logs = F.sum(F.log(F.when(factor > 0, factor).otherwise(1.0))).over(up)
    dead = F.max((factor <= 0).cast("int")).over(up)
    return ranked.withColumn("survival", F.when(dead == 1, 0.0).otherwise(F.exp(logs)))


def median_survival(curve: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    reached = F.min(F.when(F.col("survival") <= 0.5, F.col(time))).alias("median")
    return curve.groupBy(*by).agg(reached) if by else curve.agg(reached)


def decline_rate(df: DataFrame, by: Sequence[str], order: str, rate: str) -> DataFrame:
    """Exponential decline per step: minus the slope of ln(rate) on the row number of positive rates."""
    positive = df.where(F.col(rate) > 0).withColumn("__i", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("double"))
    return positive.groupBy(*by).agg((-F.regr_slope(F.log(rate), F.col("__i"))).alias("decline"), F.count(F.lit(1)).alias("n"))


def water_cut(water: Column, oil: Column) -> Column:
    """Water over all liquid, 0 without liquid."""
    return F.coalesce(water / F.nullif(water + oil, F.lit(0.0)), F.lit(0.0))


def allocate(df: DataFrame, group: Sequence[str], weight: str, total: str, name: str = "allocated") -> DataFrame:
    """A group's total by the rows' weights; equal parts where all weights are 0."""
    over = Window.partitionBy(*group)
    whole = F.sum(weight).over(over)
    return df.withColumn(name, F.when(whole == 0, F.col(total) / F.count(F.lit(1)).over(over)).otherwise(F.col(total) * F.col(weight) / whole))


def cumulative(df: DataFrame, by: Sequence[str], order: str, value: str, name: str = "cumulative") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def nearest_match(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, tolerance: float, left_id: str, columns: Sequence[str]) -> DataFrame:
    """For each left row the nearest right row of its group within the tolerance; ties take the smaller place.

    An equi-join on blocks of the tolerance's width and their neighbours.
    """
    block = lambda c: F.floor(F.col(c) / F.lit(tolerance)).cast("long")
    asked = left.select(*by, left_id, F.col(left_at).alias("__at"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: block(left_at) + d)).alias("__block"))
    held = right.select(*by, F.col(right_at).alias("__place"), F.struct(*[F.col(c) for c in columns]).alias("__row"), block(right_at).alias("__block"))
    distance = F.abs(F.col("__at") - F.col("__place"))
    near = asked.join(held, [*by, "__block"]).withColumn("distance", distance).where(F.col("distance") <= tolerance)
    best = near.groupBy(left_id).agg(F.min(F.struct("distance", "__place", "__row")).alias("b"))
    return left.join(best.select(left_id, F.col("b.distance").alias("distance"), F.col("b.__place").alias("matched_at"), "b.__row.*"), left_id, "left")


def spikes(df: DataFrame, by: Sequence[str], order: str, value: str, half: int, factor: float = 3.0) -> DataFrame:
    """Mark values further than ``factor`` deviations (1.4826 x MAD) from the median of the rows around; give the median in their place."""
    over = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    around = F.collect_list(F.col(value).cast("double")).over(over)
    middle = lambda a: F.transform(F.array(a), lambda x: (F.element_at(F.array_sort(x), F.floor((F.size(x) + 1) / 2).cast("int")) + F.element_at(F.array_sort(x), F.floor(F.size(x) / 2 + 1).cast("int"))) / 2)[0]
    with_median = df.withColumn("__around", around).withColumn("median", middle(F.col("__around")))
    off = middle(F.transform("__around", lambda x: F.abs(x - F.col("median"))))
    marked = with_median.withColumn("__off", off).withColumn("is_spike", (F.col("__off") > 0) & (F.abs(F.col(value) - F.col("median")) > factor * 1.4826 * F.col("__off")))
    return marked.withColumn("despiked", F.when(F.col("is_spike"), F.col("median")).otherwise(F.col(value).cast("double"))).drop("__around", "__off")


def map_codes(df: DataFrame, column: str, codes: DataFrame, code: str, meaning: str, name: str) -> DataFrame:
    """Code look-up that misses to the empty text."""
    one = codes.select(F.col(code).alias("__code"), F.col(meaning).alias("__meaning")).dropDuplicates(["__code"])
    return df.join(one, F.col(column) == F.col("__code"), "left").withColumn(name, F.coalesce("__meaning", F.lit(""))).drop("__code", "__meaning")


# Signals: arrays of samples, a channel a row ------------------------------------
_SAMPLES = T.ArrayType(T.DoubleType())


def _per_signal(run):
    @F.pandas_udf(_SAMPLES)
    def apply(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else run(np.asarray(v, float)).tolist())

    return apply


def spectrum(samples: Column) -> Column:
    """Magnitudes of the one-sided Fourier transform."""
    return _per_signal(lambda x: np.abs(np.fft.rfft(x)))(samples)


def power_density(samples: Column, rate: float, segment: int) -> Column:
    """Welch's density: Hann windows of ``segment`` samples, half overlapped, mean removed, one-sided."""

    def run(x: np.ndarray) -> np.ndarray:
        n = min(segment, len(x))
        if n == 0:
            return x
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        starts = range(0, len(x) - n + 1, max(1, n // 2))
        parts = [np.abs(np.fft.rfft((x[s : s + n] - x[s : s + n].mean()) * window)) ** 2 for s in starts]
        density = np.mean(parts, axis=0) / (rate * (window**2).sum())
        density[1 : (n + 1) // 2] *= 2
        return density

    return _per_signal(run)(samples)


def fir_filter(samples: Column, taps: Sequence[float]) -> Column:
    """Causal convolution with fixed taps, as long as the input."""
    kernel = np.asarray(taps, float)
    return _per_signal(lambda x: np.convolve(x, kernel)[: len(x)])(samples)


def low_pass_taps(cutoff: float, rate: float, n: int) -> list[float]:
    """Windowed-sinc taps (Hamming) of unit gain at 0."""
    k = np.arange(n) - (n - 1) / 2
    taps = np.sinc(2 * cutoff / rate * k) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    return (taps / taps.sum()).tolist()


def median_filter(samples: Column, width: int) -> Column:
    """Running median with reflected borders."""

    def run(x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, width // 2, mode="symmetric")
        return np.median(np.lib.stride_tricks.sliding_window_view(padded, width), axis=1)[: len(x)]

    return _per_signal(run)(samples)


def resample_linear(samples: Column, rate: float, new_rate: float) -> Column:
    def run(x: np.ndarray) -> np.ndarray:
        n = int(round(len(x) * new_rate / rate))
        return np.interp(np.arange(n) / new_rate, np.arange(len(x)) / rate, x) if len(x) else x

    return _per_signal(run)(samples)


def root_mean_square(samples: Column) -> Column:
    n = F.size(samples)
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(n > 0, F.sqrt(total / n))


def zero_crossings(samples: Column) -> Column:
    later = F.slice(samples, F.lit(2), F.greatest(F.size(samples) - 1, F.lit(0)))
    earlier = F.slice(samples, F.lit(1), F.greatest(F.size(samples) - 1, F.lit(0)))
    return F.size(F.filter(F.zip_with(earlier, later, lambda a, b: (a < 0) != (b < 0)), lambda x: x))


def short_time_spectrum(samples: Column, window: int, hop: int) -> Column:
    """Magnitudes of Hann-windowed frames, one after another: window // 2 + 1 a frame; only whole frames."""

    def run(x: np.ndarray) -> np.ndarray:
        if len(x) < window:
            return np.zeros(0)
        frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop]
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
        return (np.abs(np.fft.rfft(frames * hann, axis=1)) / hann.sum()).ravel()

    return _per_signal(run)(samples)


def envelope(samples: Column) -> Column:
    """Magnitude of the analytic signal (Hilbert transform)."""

    def run(x: np.ndarray) -> np.ndarray:
        n = len(x)
        if not n:
            return x
        gain = np.zeros(n)
        gain[0] = 1
        gain[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            gain[n // 2] = 1
        return np.abs(np.fft.ifft(np.fft.fft(x) * gain))

    return _per_signal(run)(samples)


def smoothed(samples: Column, window: int, order: int) -> Column:
    """Savitzky-Golay smoothing: a polynomial fitted to each window; the first and last windows' own fits at the borders."""
    if window % 2 == 0 or not 0 <= order < window:
        raise ValueError("the window must be odd and larger than the order")
    half = window // 2
    powers = np.arange(-half, half + 1)[:, None] ** np.arange(order + 1)
    fit = powers @ np.linalg.pinv(powers)  # values of the fitted polynomial at all places of a window

    def run(x: np.ndarray) -> np.ndarray:
        if len(x) < window:
            return x
        windows = np.lib.stride_tricks.sliding_window_view(x, window)
        return np.concatenate([fit[:half] @ x[:window], windows @ fit[half], fit[half + 1 :] @ x[-window:]])

    return _per_signal(run)(samples)


def cross_spectrum(left: Column, right: Column) -> Column:
    """Magnitudes of the one-sided cross spectrum of two signals of equal length."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.abs(np.fft.rfft(np.asarray(x, float)) * np.conj(np.fft.rfft(np.asarray(y, float)))) for x, y in zip(a, b, strict=True)])

    return run(left, right)
