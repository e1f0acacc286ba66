"""Series against their own past and against each other: sample entropy, autoregression, alignment by cross-correlation, singular spectra.

Long series are cut to blocks whose sums merge; what is gathered in a task is a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.functions.blocks import each_block, gathered, keyed, place, series_ends
from millrace.functions.storage import written

#: Templates of a cell that are compared as one array.
GROUP = 512
#: Types, beside plain text, whose values Arrow hands on as they are.
_PLAIN = (T.NumericType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _named(found: DataFrame, df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Results by key with the series' own columns in its place, a row for each series of ``df``."""
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    series = df.select(*by, key.alias("key")).distinct()
    return series.join(found, "key", "left").drop("key")


# Templates -----------------------------------------------------------------
def _templates(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, length: int) -> DataFrame:
    """(key, id, x, more): runs of ``length`` values that another value follows, with that one; more: whether yet another does."""

    def run(keys, ends, own, values):
        x = values[0]
        at = np.flatnonzero(np.arange(own) + length < ends[:own])
        if len(at):
            seen = x[at[:, None] + np.arange(length + 1)]
            good = ~np.isnan(seen[:, :length]).any(axis=1)
            at, seen = at[good], seen[good]
            more = at + length + 1 < ends[at]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at], pa.string()), pa.array(list(seen), pa.list_(pa.float64())), pa.array(more)], names=["key", "x", "more"])

    return each_block(keyed(df, by, order, [value]), length + 1, "key string, x array<double>, more boolean", run)


def template_matches(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, length: int, tolerance: float) -> DataFrame:
    """(key, matches, longer): ordered pairs of different runs of a series that differ by less than ``tolerance`` in each place.

    matches: of the runs of ``length`` values that another value follows; longer: of the runs of one more that another follows.
    Runs meet in cells as wide as the tolerance; a cell's runs are dealt to groups of some ``GROUP``, which are compared as arrays,
    so no pair is ever a row.
    """
    if not isinstance(length, int) or length < 1 or not tolerance > 0:
        raise ValueError("the length must be a positive whole number and the tolerance positive")
    width = tolerance * (1 + 1e-9)
    axes = range(min(length, 2))
    found = written(_templates(df, by, order, value, length).withColumn("id", F.monotonically_increasing_id()))
    # The runs of a short series are one group, wherever they lie.
    long = found.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > GROUP).select("key", F.lit(True).alias("long"))
    cell = F.array(*[F.when(F.col("long"), F.floor(F.get("x", F.lit(a)) / width)).otherwise(0) for a in axes])
    runs = found.join(long, "key", "left").withColumn("cell", cell).drop("long")
    groups = runs.groupBy("key", "cell").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("k"))
    dealt = runs.join(groups, ["key", "cell"]).withColumn("g", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    packed = written(dealt.groupBy("key", "cell", "g").agg(F.flatten(F.collect_list("x")).alias("x"), F.collect_list("more").alias("more")))
    # Each cell meets itself and the half of its neighbours that come after it; such pairs count twice.
    steps = [(0,), (1,)] if len(axes) == 1 else [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    shifted = F.array(*[F.array(*[F.get("cell", F.lit(a)) + s[a] for a in axes]) for s in steps])
    left = packed.select("key", F.col("g").alias("g1"), F.col("cell").alias("from"), F.explode(shifted).alias("cell"), F.col("x").alias("x1"), F.col("more").alias("more1"))
    right = packed.select("key", "cell", F.col("g").alias("g2"), F.col("x").alias("x2"), F.col("more").alias("more2"))
    met = left.join(right.hint("merge"), ["key", "cell"]).where("from <> cell OR g1 <= g2")
    inside = (F.col("from") == F.col("cell")) & (F.col("g1") == F.col("g2"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers = [], []
            for key, same, *cells in zip(*[batch.column(i) for i in range(6)], strict=True):
                a, b = (np.asarray(cells[i].values, np.float64).reshape(-1, length + 1) for i in (0, 2))
                more_a, more_b = (np.asarray(cells[i].values.to_pylist(), bool) for i in (1, 3))
                near = np.ones((len(a), len(b)), bool)
                for p in range(length):
                    near &= np.abs(a[:, p, None] - b[None, :, p]) < tolerance
                also = near & more_a[:, None] & more_b[None, :] & (np.abs(a[:, -1, None] - b[None, :, -1]) < tolerance)
                own = same.as_py()
                keys.append(key.as_py())
                numbers.append([int(m.sum()) - int(m.diagonal().sum()) if own else 2 * int(m.sum()) for m in (near, also)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([n[i] for n in numbers], pa.int64()) for i in (0, 1)]], names=["key", "matches", "longer"])

    counted = met.select("key", inside.alias("same"), "x1", "more1", "x2", "more2").mapInArrow(count, "key string, matches long, longer long")
    return counted.groupBy("key").agg(F.sum("matches").alias("matches"), F.sum("longer").alias("longer"))


def sample_entropy(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, length: int = 2, tolerance: float = 0.2) -> DataFrame:
    """(by, matches, longer, sample_entropy) of each series: minus the logarithm of the share of matches that go on; 0 without matches, infinite if none goes on.

    Rows without a value are left out of their series; runs with NaN match nothing.
    """
    found = _named(template_matches(df, by, order, value, length, tolerance), df, by)
    n, more = F.coalesce("matches", F.lit(0).cast("long")), F.coalesce("longer", F.lit(0).cast("long"))
    entropy = F.when(n == 0, 0.0).when(more == 0, float("inf")).otherwise(-F.log(more / n))
    return found.select(*by, n.alias("matches"), more.alias("longer"), entropy.alias("sample_entropy"))


# Autoregression ------------------------------------------------------------
def _levinson(r: np.ndarray) -> np.ndarray:
    """Coefficients a with x(n) = a1 x(n-1) + ... from the autocorrelations r0, r1, ..."""
    a, error = np.zeros(0), r[0]
    for k in range(1, len(r)):
        reflection = 0.0 if error <= 0 else (r[k] - a @ r[k - 1 : 0 : -1]) / error
        a = np.r_[a - reflection * a[::-1], reflection]
        error *= 1 - reflection * reflection
    return a


def autoregression(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, lags: int, method: str = "yule_walker") -> DataFrame:
    """(by, n, coefficients, variance) of each series' autoregressive model without a constant.

    coefficients: of the values 1, 2, ... rows before; variance: of the residuals of all rows with ``lags`` rows before them. yule_walker: from the
    autocorrelations, by the Levinson recursion; ols: least squares. Both need lagged products alone, which blocks sum. Series of no
    more than ``lags`` rows have null results; rows without a value are left out.
    """
    if not isinstance(lags, int) or lags < 1 or method not in ("yule_walker", "ols"):
        raise ValueError("lags must be a positive whole number and the method yule_walker or ols")
    p = lags + 1

    def run(keys, ends, own, values):
        x, start = values[0], 0
        found, numbers = [], []
        while start < own:
            end = ends[start]
            i = np.arange(start, min(end, own))
            auto = [float(x[i[i + k < end]] @ x[i[i + k < end] + k]) for k in range(p)]
            whole = i[i + lags < end]
            seen = x[whole[:, None] + np.arange(lags, -1, -1)]  # the row itself, then the one before it, ...
            found.append(keys[start])
            numbers.append([float(len(i)), float(len(whole)), *auto, *seen.sum(axis=0), *(seen.T @ seen).ravel()])
            start = end
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(numbers, pa.list_(pa.float64()))], names=["key", "s"])

    parts = each_block(keyed(df, by, order, [value]), lags, "key string, s array<double>", run)
    sums = parts.groupBy("key").agg(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(2 + 2 * p + p * p)])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([np.asarray(batch.column(i), np.float64) for i in range(1, batch.num_columns)]) if batch.num_rows else np.zeros((0, 1))
            fits = []
            for s in rows:
                n, auto, total, product = s[1], s[2 : 2 + p], s[2 + p : 2 + 2 * p], s[2 + 2 * p :].reshape(p, p)
                if n < 1 or not np.isfinite(s).all():
                    fits.append((None, None))
                    continue
                a = _levinson(auto) if method == "yule_walker" else np.linalg.lstsq(product[1:, 1:], product[1:, 0], rcond=None)[0]
                c = np.r_[1.0, -a]
                fits.append((a.tolist(), max(0.0, float(c @ product @ c / n - (c @ total / n) ** 2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(r[0]) for r in rows], pa.int64()), pa.array([f[0] for f in fits], pa.list_(pa.float64())), pa.array([f[1] for f in fits], pa.float64())], names=["key", "n", "coefficients", "variance"])

    fitted = sums.mapInArrow(solve, "key string, n long, coefficients array<double>, variance double")
    return _named(fitted, df, by).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


# Alignment -----------------------------------------------------------------
def cross_correlation(df: DataFrame, by: Sequence[str], order: Sequence[str], reference: str, target: str, most: int) -> DataFrame:
    """(key, lag, score) for lags from -most to most: the sum of reference(n + lag) * target(n) over a series' rows that have both values."""
    if not isinstance(most, int) or most < 1:
        raise ValueError("the largest lag must be a positive whole number")

    def run(keys, ends, own, values):
        r, t = values
        start, found = 0, []
        while start < own:
            end = ends[start]
            i = np.arange(start, min(end, own))
            for k in range(most + 1):
                j = i[i + k < end]
                found.append((keys[start], k, float(r[j + k] @ t[j])))
                if k:
                    found.append((keys[start], -k, float(r[j] @ t[j + k])))
            start = end
        k, lag, score = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(lag, pa.int64()), pa.array(score, pa.float64())], names=["key", "lag", "score"])

    parts = each_block(keyed(df, by, order, [reference, target]), most, "key string, lag long, score double", run)
    return parts.groupBy("key", "lag").agg(F.sum("score").alias("score"))


def best_lag(df: DataFrame, by: Sequence[str], order: Sequence[str], reference: str, target: str, most: int) -> DataFrame:
    """(by, lag, score) of each series: the lag at which its target is most like its reference, the least of equals."""
    top = F.max_by(F.struct("lag", "score"), F.struct("score", -F.col("lag"))).alias("b")
    scores = cross_correlation(df, by, order, reference, target, most).groupBy("key").agg(top)
    return _named(scores.select("key", "b.lag", "b.score"), df, by)


def aligned(df: DataFrame, by: Sequence[str], order: Sequence[str], reference: str, target: str, most: int) -> DataFrame:
    """(key, n, reference, aligned): each series' rows that have both values, the target moved by its best lag and 0 where nothing comes in."""
    rows = written(keyed(df, by, order, [reference, target]))
    top = F.max_by("lag", F.struct("score", -F.col("lag"))).alias("lag")
    lags = cross_correlation(df, by, order, reference, target, most).groupBy("key").agg(top)
    moved = rows.join(lags, "key").select("key", (F.col("n") + F.col("lag")).alias("n"), F.col("v1").alias("aligned"))
    return rows.join(moved, ["key", "n"], "left").select("key", "n", F.col("v0").alias("reference"), F.coalesce("aligned", F.lit(0.0)).alias("aligned"))


# Singular spectra ----------------------------------------------------------
def singular_spectrum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, window: int, components: int) -> DataFrame:
    """(by, n, value, component, part): each series as a sum of ``components`` parts of largest weight, a row a place and part.

    Windows of ``window`` values are the columns of a matrix; its products are sums over blocks, a small matrix a series,
    whose eigenvectors give the parts. A window's share of a part is averaged over all windows that hold a place. n numbers the
    rows of all series, those of one behind those of another; rows without a value are left out, and series shorter than the window give no rows.
    All ``window`` parts sum to the series. The order of parts of equal weight is open.
    """
    if not isinstance(window, int) or window < 2 or not isinstance(components, int) or not 0 < components <= window:
        raise ValueError("the window must be a whole number above 1, and there are 1 to window components")
    rows = written(keyed(df, by, order, [value]))

    def windows(keys, ends, own, x):
        """Each series of the block: its key and its windows."""
        start = 0
        while start < own:
            end = ends[start]
            i = np.arange(start, min(end, own))
            i = i[i + window <= end]
            if len(i):
                yield keys[start], x[i[:, None] + np.arange(window)]
            start = end

    def products(keys, ends, own, values):
        for key, seen in windows(keys, ends, own, values[0]):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([(seen.T @ seen).ravel().tolist()], pa.list_(pa.float64()))], names=["key", "s"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One matrix a series of a task, so that few go through the shuffle."""
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[key] = total.get(key, 0.0) + np.asarray(s.values)
            if len(total) > 1000:
                yield _matrices(total)
                total = {}
        yield _matrices(total)

    parts = each_block(rows, window - 1, "key string, s array<double>", products).mapInArrow(summed, "key string, s array<double>")
    whole = parts.select("key", F.posexplode("s").alias("i", "v")).groupBy("key", "i").agg(F.sum("v").alias("v")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.linalg.eigh(np.asarray(m.values).reshape(window, window))[1][:, ::-1][:, :components].T.ravel().tolist() for m in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["key", "u"])

    bases = written(whole.select("key", "m.v").mapInArrow(vectors, "key string, u array<double>"))

    # Each block gets the bases and the columns of its series, and the rows before and behind it that share windows with its own.
    extents = rows.groupBy("key").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    names = [f"s{i}" for i in range(len(by))]
    series = df.select(*[F.col(c).alias(s) for c, s in zip(by, names, strict=True)], (F.to_json(F.struct(*by)) if by else F.lit("")).alias("key")).distinct()
    plain = all(isinstance(t := series.schema[s].dataType, _PLAIN) or t == T.StringType() for s in names)
    shown = names if plain else []
    known = bases.join(extents, "key").join(series, "key") if plain else bases.join(extents, "key")
    held = known.withColumn("block", F.explode(F.sequence(place(F.col("least")), place(F.col("most")))))
    met = gathered(rows, window - 1, window - 1).join(held.groupBy("block").agg(F.collect_list(F.struct("key", "u", *shown)).alias("b")), "block")

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A window's share of a part at its place j is (u . x) u[j]; places average their windows'."""
        for batch in batches:
            for first, last, n, keys, x, known, u, *columns in zip(*[batch.column(i) for i in range(batch.num_columns)], strict=True):
                n, x, keys = np.asarray(n.values), np.asarray(x.values, np.float64), keys.values.to_pylist()
                low, high = np.searchsorted(n, first.as_py()), np.searchsorted(n, last.as_py(), side="right")
                ends = np.unique(series_ends(keys))
                spans = {keys[end - 1]: (start, end) for start, end in zip([0, *ends[:-1]], ends, strict=True)}
                found = []
                for i, (key, base) in enumerate(zip(known.values.to_pylist(), np.asarray(u.values.flatten(), np.float64).reshape(-1, components, window), strict=True)):
                    start, end = spans.get(key, (0, 0))
                    own = slice(max(start, low) - start, max(min(end, high), max(start, low)) - start)
                    if end - start >= window and own.stop > own.start:
                        over = np.convolve(np.ones(end - start - window + 1), np.ones(window))[own]
                        found.append((i, x[start:end], base, own, over, np.arange(start, end)[own]))
                if not found:
                    continue
                at, which = np.concatenate([f[-1] for f in found]), pa.array(np.repeat([f[0] for f in found], [len(f[-1]) for f in found]))
                for c in range(components):
                    part = np.concatenate([np.convolve(np.correlate(v, base[c], "valid"), base[c])[own] / over for _, v, base, own, over, _ in found])
                    yield pa.RecordBatch.from_arrays([*[s.values.take(which) for s in (known, *columns)], pa.array(n[at]), pa.array(x[at]), pa.array(np.full(len(at), c, np.int32)), pa.array(part)], names=["key", *shown, "n", "value", "component", "part"])

    schema = T.StructType([T.StructField(s, series.schema[s].dataType) for s in ("key", *shown)])
    for name, kind in (("n", T.LongType()), ("value", T.DoubleType()), ("component", T.IntegerType()), ("part", T.DoubleType())):
        schema.add(name, kind)
    made = met.select("first", "last", "r.n", "r.key", "r.v0", F.col("b.key").alias("known"), "b.u", *[f"b.{s}" for s in shown]).mapInArrow(parts_of, schema)
    named = made if plain else made.join(series, "key")
    return named.select(*[F.col(s).alias(c) for c, s in zip(by, names, strict=True)], "n", "value", "component", "part")


def _matrices(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([m.tolist() for m in total.values()], pa.list_(pa.float64()))], names=["key", "s"])
