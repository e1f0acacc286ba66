"""Decline curves fitted to the rates of many wells at once.

Straight-line fits are grouped sums. The hyperbolic curve is fitted by damped Gauss-Newton rounds: the normal equations of all wells that are
not done are sums over their rows, a step is a 3 x 3 system a well, and wells that have converged leave. Rows of a well meet in one
task, which fits many wells at once. Those of a well with very many rows are never gathered: each of its rounds is a job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from millrace.functions.storage import rewritten, written

# Days a year, first guesses of the decline a day and of the exponent, least rate in logarithms, bounds of (rate, decline, exponent).
YEAR, DECLINE, EXPONENT, LEAST = 365.0, 0.15 / 365.0, 0.5, 1e-9
LOW, HIGH = np.array([0.0, 1e-9, 1e-6]), np.array([np.inf, np.inf, 0.9999])
#: Rows of a well that are gathered at most, and rows of wells that are fitted at once.
WHOLE, TOGETHER = 100_000, 100_000
_PARTS = ["s", "g0", "g1", "g2", "h00", "h01", "h02", "h11", "h12", "h22"]
_STATE = [*(f"p{i}" for i in range(3)), *(f"c{i}" for i in range(3)), *_PARTS, "damp"]


def _line(x: Column, y: Column) -> tuple[Column, Column]:
    """Slope and intercept of the least-squares line of a group."""
    return F.regr_slope(y, x), F.regr_intercept(y, x)


def straight_decline(df: DataFrame, by: Sequence[str], days: str, rate: str, method: str) -> DataFrame:
    """(by, qi, di_per_year, b) of an exponential (b = 0) or harmonic (b = 1) decline: a line through logarithms, or through reciprocals, of the rates.

    Rows without a time or a rate do not count; a well of one row has its rate and no decline, one of none 0.
    """
    if method not in ("exponential", "harmonic"):
        raise ValueError("the method is exponential or harmonic")
    t, q = F.col("__t"), F.col("__q")
    known = df.select(*by, F.col(days).cast("double").alias("__t"), F.col(rate).cast("double").alias("__q"))
    known = known.withColumns({"__t": F.when(q.isNotNull(), t), "__q": F.when(t.isNotNull(), q)})
    if method == "exponential":
        slope, base = _line(t, F.when(q + LEAST > 0, F.log(q + LEAST)))
        fitted, decline, b = F.exp(base), -slope, 0.0
    else:
        slope, base = _line(t, 1.0 / F.nullif(q + LEAST, F.lit(0.0)))
        fitted = 1.0 / F.greatest(base, F.lit(LEAST))
        decline, b = slope * fitted, 1.0
    n = F.count("__q")
    few = (n < 2) | slope.isNull()
    return known.groupBy(*by).agg(
        F.when(few, F.coalesce(F.avg("__q"), F.lit(0.0))).otherwise(fitted).alias("qi"),
        F.when(few, 0.0).otherwise(decline * YEAR).alias("di_per_year"),
        F.when(few, 0.0).otherwise(F.lit(b)).alias("b"),
    )


def _sums() -> list[Column]:
    """Squared residuals at the candidate (c0, c1, c2), and the gradient and matrix of the normal equations."""
    q, t = F.col("__q"), F.col("__t")
    x = F.col("c2") * F.col("c1") * t
    g = F.exp(-F.log1p(x) / F.col("c2"))
    e = q - F.col("c0") * g
    d = [g, -F.col("c0") * g * t / (1 + x), F.col("c0") * g * (F.log1p(x) / (F.col("c2") * F.col("c2")) - F.col("c1") * t / (F.col("c2") * (1 + x)))]
    pairs = [d[i] * d[j] for i in range(3) for j in range(i, 3)]
    return [F.sum(c).alias(f"n_{n}") for n, c in zip(_PARTS, [e * e, *[k * e for k in d], *pairs], strict=True)]


def _stepped(rows: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(state, done) after a round; columns of ``rows``: the state, then the sums at its candidate."""
    p, c, parts, damp = rows[:, :3].copy(), rows[:, 3:6], rows[:, 6:16].copy(), rows[:, 16].copy()
    new = rows[:, 17:27]
    better = np.isfinite(new).all(axis=1) & ~(new[:, 0] >= parts[:, 0])  # the first sums are NaN and give way
    moved = np.abs(c - p) <= tolerance * np.maximum(np.abs(p), LOW)
    gained = parts[:, 0] - new[:, 0]
    still = np.isfinite(parts[:, 0]) & (moved.all(axis=1) | better & (gained <= 1e-15 * new[:, 0])) | (new[:, 0] <= 1e-28)
    p[better], parts[better] = c[better], new[better]
    damp = np.where(better, damp / 5, damp * 4)
    g = parts[:, 1:4]
    h = parts[:, [4, 5, 6, 5, 7, 8, 6, 8, 9]].reshape(-1, 3, 3)
    diagonal = np.einsum("nii->ni", h)
    stuck = (p <= LOW) & (g < 0) | (p >= HIGH) & (g > 0)
    a = h + np.eye(3) * (damp[:, None] * np.maximum(diagonal, 1e-300))[:, :, None]
    scale = 1 / np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
    a = a * scale[:, :, None] * scale[:, None, :]
    free = ~stuck
    a = np.where(free[:, :, None] & free[:, None, :], a, 0) + np.eye(3) * stuck[:, :, None]
    good = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(g).all(axis=1)
    step = np.zeros_like(p)
    step[good] = np.linalg.solve(a[good] + 1e-15 * np.eye(3), np.where(free, g * scale, 0)[good][:, :, None])[:, :, 0]
    candidate = np.clip(p + step * scale, LOW, HIGH)
    lost = ~better & (damp > 1e15)
    return np.column_stack([p, candidate, parts, damp]), still | lost | (stuck.all(axis=1) & good)


def _fitted(t: np.ndarray, q: np.ndarray, begin: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """(rate, decline, exponent, squared residuals) of wells whose rows follow each other in the order of time, from ``begin`` on; NaN where the rounds do not end."""
    n = len(begin)
    size = np.diff(np.r_[begin, len(t)])
    out = np.full((n, 4), np.nan)
    first = np.where(q[begin] > 0, q[begin], 1.0)
    guess = np.column_stack([first, np.full(n, DECLINE), np.full(n, EXPONENT)])
    state = np.column_stack([guess, guess, np.full((n, len(_PARTS)), np.nan), np.full(n, 1e-3)])
    wells = np.arange(n)
    for _ in range(rounds):
        if not len(wells):
            break
        c0, c1, c2 = np.repeat(state[:, 3:6], size, axis=0).T
        x = c2 * c1 * t
        log = np.log1p(x)
        g = np.exp(-log / c2)
        e = q - c0 * g
        d = [g, -c0 * g * t / (1 + x), c0 * g * (log / (c2 * c2) - c1 * t / (c2 * (1 + x)))]
        pairs = [d[i] * d[j] for i in range(3) for j in range(i, 3)]
        start = np.r_[0, np.cumsum(size)[:-1]]
        sums = np.column_stack([np.add.reduceat(v, start) for v in (e * e, *[k * e for k in d], *pairs)])
        state, done = _stepped(np.column_stack([state, sums]), tolerance)
        out[wells[done]] = state[done][:, [0, 1, 2, 6]]
        kept = np.repeat(~done, size)
        t, q, size, state, wells = t[kept], q[kept], size[~done], state[~done], wells[~done]
    return out


def _fitted_whole(rows: DataFrame, keys: list[str], rounds: int, tolerance: float) -> DataFrame:
    """(keys, p0, p1, p2, s) of wells whose rows meet in a task; many wells are fitted at once, a row of theirs stands for each."""
    order = Window.partitionBy(*keys).orderBy("__t")
    placed = rows.select(*keys, "__t", "__q", (F.row_number().over(order) == 1).alias("__first"))
    names = ["p0", "p1", "p2", "s"]
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(n, T.DoubleType()) for n in names]])
    n = len(keys)

    def fits(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        begin = np.flatnonzero(np.asarray(whole.column(n + 2)))
        with np.errstate(all="ignore"):
            found = _fitted(np.asarray(whole.column(n)), np.asarray(whole.column(n + 1)), begin, rounds, tolerance)
        keep = np.isfinite(found[:, 3]) & (np.diff(np.r_[begin, whole.num_rows]) >= 4)
        at = pa.array(begin[keep])
        return pa.RecordBatch.from_arrays([*[whole.column(i).take(at) for i in range(n)], *[pa.array(c) for c in found[keep].T]], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(np.asarray(batch.column(n + 2)))
            if len(starts) and sum(b.num_rows for b in held) + starts[-1] >= TOGETHER:
                if starts[-1]:
                    held.append(batch.slice(0, starts[-1]))
                yield fits(held)
                held = []
                batch = batch.slice(starts[-1])
            if batch.num_rows:
                held.append(batch)
        if held:
            yield fits(held)

    return placed.mapInArrow(run, schema)


def _fitted_by_rounds(rows: DataFrame, keys: list[str], rounds: int, tolerance: float) -> DataFrame:
    """(keys, p0, p1, p2, s) of wells with very many rows, which stay where they are: each round sums over them."""
    rows = written(rows)
    first = F.min_by("__q", "__t")
    nan = F.lit(float("nan"))
    start = {"c0": F.when(F.col("__q0") > 0, F.col("__q0")).otherwise(1.0), "c1": F.lit(DECLINE), "c2": F.lit(EXPONENT)}
    wells = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), first.alias("__q0")).where("__n >= 4")
    state = wells.select(*keys, *[start[f"c{i}"].alias(f"p{i}") for i in range(3)], *[start[f"c{i}"].alias(f"c{i}") for i in range(3)], *[nan.alias(n) for n in _PARTS], F.lit(1e-3).alias("damp"))
    state = written(state)
    kinds = T.StructType([*[state.schema[k] for k in keys], *[T.StructField(n, T.DoubleType()) for n in _STATE], T.StructField("done", T.BooleanType())])
    n = len(keys)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                with np.errstate(all="ignore"):
                    now, done = _stepped(np.column_stack([np.asarray(batch.column(i), np.float64) for i in range(n, batch.num_columns)]), tolerance)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(c) for c in now.T], pa.array(done)], names=kinds.names)

    finished = []
    for _ in range(rounds):
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
        asked = state.select(*keys, "c0", "c1", "c2").alias("s")
        met = rows.alias("r").join(asked, same)
        sums = met.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys]).agg(*_sums())
        both = state.alias("s").join(sums.alias("r"), same).select(*[F.col(f"s.{c}") for c in (*keys, *_STATE)], *[F.col(f"r.n_{c}") for c in _PARTS])
        stepped = rewritten(both.mapInArrow(step, kinds))
        finished.append(stepped.where("done").select(*keys, "p0", "p1", "p2", "s"))
        state = stepped.where("NOT done").drop("done")
        if state.isEmpty():
            break
    found = finished[0]
    for more in finished[1:]:
        found = found.union(more)
    return found


def hyperbolic_decline(df: DataFrame, by: Sequence[str], days: str, rate: str, rounds: int = 80, tolerance: float = 1e-11) -> DataFrame:
    """(by, qi, di_per_year, b, sse, converged): least squares of qi * (1 + b d t) ** (-1 / b), d > 0 and 0 < b < 1.

    From the well's first rate, 15 % a year and b = 0.5. A well that has not converged after ``rounds`` gets the exponential fit, as
    those of fewer than four rows do; converged is false and sse null for it.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(days).cast("double").alias("__t"), F.col(rate).cast("double").alias("__q"))
    finite = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("__t", "__q"))
    rows = rows.where(finite)
    large = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > WHOLE).select(*keys))
    if large.isEmpty():
        found = _fitted_whole(rows, keys, rounds, tolerance)
    else:
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
        own = lambda how: rows.alias("r").join(large.alias("l"), same, how)
        found = _fitted_whole(own("left_anti"), keys, rounds, tolerance).union(_fitted_by_rounds(own("left_semi"), keys, rounds, tolerance))
    lines = straight_decline(df, by, days, rate, "exponential")
    good = F.coalesce(F.col("f.s") >= 0, F.lit(False))
    joined = lines.alias("l").join(found.alias("f"), [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{k}")) for c, k in zip(by, keys, strict=True)], "left")
    pick = lambda fitted, line: F.when(good, F.col(fitted)).otherwise(F.col(line))
    return joined.select(*[F.col(f"l.{c}") for c in by], pick("f.p0", "l.qi").alias("qi"), F.when(good, F.col("f.p1") * YEAR).otherwise(F.col("l.di_per_year")).alias("di_per_year"), pick("f.p2", "l.b").alias("b"), F.when(good, F.col("f.s")).alias("sse"), good.alias("converged"))
