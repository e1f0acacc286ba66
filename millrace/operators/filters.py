"""Recursive filters and Kalman estimates along series of any length, as associative scans over ranges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.scans import Scan, associative_scan

Section = tuple[Sequence[float], Sequence[float]]


def _section(numerator: Sequence[float], denominator: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A difference equation as state' = A state + B x, y = C state + D x."""
    b, a = np.asarray(numerator, float), np.asarray(denominator, float)
    if not len(b) or not len(a) or a[0] == 0 or not np.isfinite(np.r_[a, b]).all():
        raise ValueError("a filter needs numerator and denominator of finite numbers, the first of the denominator not zero")
    d = max(len(a), len(b)) - 1
    b, a = np.pad(b / a[0], (0, d + 1 - len(b))), np.pad(a / a[0], (0, d + 1 - len(a)))
    state = np.eye(d, k=1)
    if d:
        state[:, 0] -= a[1:]
    return state, b[1:] - a[1:] * b[0], np.eye(1, d)[0], b[0]


def _series(sections: Sequence[Section]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Filters one behind the other as one state space."""
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for numerator, denominator in sections:
        a2, b2, c2, d2 = _section(numerator, denominator)
        a = np.block([[a, np.zeros((len(a), len(a2)))], [np.outer(b2, c), a2]])
        b, c, d = np.r_[b, b2 * d], np.r_[d2 * c, c2], d * d2
    return a, b, c, d


def recursive_filter(df: DataFrame, value: str, order: Sequence[str | Column], sections: Sequence[Section], by: Sequence[str] = (), name: str = "filtered") -> DataFrame:
    """``df`` with the response of a recursive filter at rest before each series.

    sections: (numerator, denominator) pairs, applied one after the other; a0 y(n) = b0 x(n) + b1 x(n-1) + ... - a1 y(n-1) - ...
    by: columns of equal values in a series (none: one series). Rows without a value get none and leave the filter as it is.
    """
    a, b, c, d = _series(sections)
    k = len(a)

    def elements(values, starts):
        maps = np.broadcast_to(a, (len(starts), k, k)) * (~starts)[:, None, None]
        return np.hstack([maps.reshape(len(starts), k * k), values[0][:, None] * b])

    def compose(x, y):
        p, q = x[:, : k * k].reshape(len(x), k, k), y[:, : k * k].reshape(len(y), k, k)
        moved = np.einsum("nij,nj->ni", q, x[:, k * k :]) + y[:, k * k :]
        return np.hstack([(q @ p).reshape(len(x), k * k), moved])

    def outputs(upto, before, values, starts):
        return [np.where(starts[:, None], 0.0, before[:, k * k :]) @ c + d * values[0]]

    return associative_scan(df, by, order, [value], Scan(elements, compose, outputs), [name])


def butterworth(kind: str, cutoff: float | tuple[float, float], order: int, rate: float) -> list[Section]:
    """Sections of second order of a digital Butterworth filter (bilinear transform, frequencies prewarped).

    kind: lowpass or highpass with one cutoff, bandpass or bandstop with a (low, high) pair, in the unit of ``rate``.
    """
    band = kind in ("bandpass", "bandstop")
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if kind not in ("lowpass", "highpass", "bandpass", "bandstop") or not isinstance(order, int) or order < 1 or len(edges) != 1 + band:
        raise ValueError("a filter is lowpass, highpass, bandpass or bandstop, of a positive order, with one cutoff or a pair")
    if not (0 < edges[0] <= edges[-1] < rate / 2) or band and edges[0] == edges[1]:
        raise ValueError("cutoffs must rise, between zero and half the rate")
    warped = 2 * rate * np.tan(np.pi * edges / rate)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "lowpass":
        poles, zeros, at = poles * warped[0], np.zeros(0), 0.0
    elif kind == "highpass":
        poles, zeros, at = warped[0] / poles, np.zeros(order), np.inf
    else:
        wide, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * wide / 2 if kind == "bandpass" else wide / 2 / poles
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles = np.r_[half + root, half - root]
        zeros = np.zeros(order) if kind == "bandpass" else np.r_[np.full(order, 1j * centre), np.full(order, -1j * centre)]
        at = centre if kind == "bandpass" else 0.0
    digital = (2 * rate + poles) / (2 * rate - poles)
    ends = np.r_[(2 * rate + zeros) / (2 * rate - zeros), -np.ones(len(poles) - len(zeros))]
    # Each pole goes with its conjugate; real poles go in pairs, or alone.
    upper, real = digital[digital.imag > 1e-9], np.sort(digital[np.abs(digital.imag) <= 1e-9].real)
    pairs = [np.array([p, p.conj()]) for p in upper] + [real[i : i + 2] for i in range(0, len(real), 2)]
    top, flat = ends[ends.imag > 1e-9], np.sort(ends[np.abs(ends.imag) <= 1e-9].real)
    flat = list(np.r_[flat[: (len(flat) + 1) // 2], flat[(len(flat) + 1) // 2 :][::-1]]) if kind == "bandpass" else list(flat)
    sections = []
    for i, pair in enumerate(pairs):
        if len(top):
            own = np.array([top[i], top[i].conj()])
        elif kind == "bandpass":
            own = np.array([flat.pop(0), flat.pop()]) if len(pair) == 2 else np.array([flat.pop(0)])
        else:
            own = np.array([flat.pop() for _ in range(len(pair))])
        sections.append((np.poly(own).real, np.poly(pair).real))
    z = 1.0 if at == 0 else -1.0 if at == np.inf else np.exp(2j * np.arctan(at / (2 * rate)))
    for i, (b, a) in enumerate(sections):  # unit gain of each section where the filter passes
        sections[i] = (b / abs(np.polyval(b, z) / np.polyval(a, z)), a)
    return sections


def exponential_smoothing(df: DataFrame, value: str, order: Sequence[str | Column], weight: float, by: Sequence[str] = (), name: str = "smoothed") -> DataFrame:
    """Each value moved towards the smoothed one before it: weight * x + (1 - weight) * last, from zero."""
    return recursive_filter(df, value, order, [([weight], [1.0, weight - 1.0])], by, name)


def kalman_filter(df: DataFrame, value: str, order: Sequence[str | Column], process: float, measurement: float, by: Sequence[str] = (), start: float | None = None, variance: float = 1.0, names: tuple[str, str] = ("estimate", "variance")) -> DataFrame:
    """``df`` with the mean and variance of a random walk's state given the values so far.

    process, measurement: variances of the walk's steps and of the values. A series starts from ``start`` (none: its first value) with
    ``variance``, before the first step. Rows without a value get none and count as no step.
    """
    if process <= 0 or measurement <= 0:
        raise ValueError("the variances must be positive")
    q, r = float(process), float(measurement)

    def elements(values, starts):
        z = values[0]
        gain = np.where(starts, (variance + q) / (variance + q + r), q / (q + r))
        mean = z if start is None else start + gain * (z - start)
        n = np.zeros(len(z))
        return np.column_stack([
            np.where(starts, 0, 1 - gain), np.where(starts, mean, gain * z), (1 - gain) * np.where(starts, variance + q, q),
            np.where(starts, 0, z / (q + r)), np.where(starts, n, 1 / (q + r)),
        ])

    def compose(x, y):
        (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = x.T, y.T
        d = 1 + c1 * j2
        return np.column_stack([a1 * a2 / d, a2 * (b1 + c1 * e2) / d + b2, a2 * a2 * c1 / d + c2, a1 * (e2 - j2 * b1) / d + e1, a1 * a1 * j2 / d + j1])

    return associative_scan(df, by, order, [value], Scan(elements, compose, lambda upto, before, values, starts: [upto[:, 1], upto[:, 2]]), list(names))


def kalman_smoother(df: DataFrame, value: str, order: Sequence[str], process: float = 0.01, measurement: float = 1.0, by: Sequence[str] = (), start: float | None = 0.0, variance: float = 1.0, names: tuple[str, str] = ("smoothed", "smoothed_variance")) -> DataFrame:
    """``df`` with the mean and variance of a random walk's state given all values of its series: a scan forwards, and one back."""
    q = float(process)
    made = ("__mean", "__variance")
    forward = kalman_filter(df, value, order, process, measurement, by, start, variance, made)

    def elements(values, starts):
        mean, var = values
        e = np.where(starts, 0, var / (var + q))
        return np.column_stack([e, (1 - e) * mean, (1 - e) * var])

    def compose(x, y):
        (e1, g1, l1), (e2, g2, l2) = x.T, y.T
        return np.column_stack([e1 * e2, e2 * g1 + g2, e2 * e2 * l1 + l2])

    scan = Scan(elements, compose, lambda upto, before, values, starts: [upto[:, 1], upto[:, 2]])
    return associative_scan(forward, by, [F.col(o).desc() for o in order], made, scan, list(names)).drop(*made)
