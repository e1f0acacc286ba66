"""Data preparation and evaluation for models, as SQL-shaped operators on real rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.functions.ranges import numbered, quantiles, running
from millrace.functions.storage import written


def hash_split(df: DataFrame, keys: Sequence[str], parts: Mapping[str, float], seed: int = 0, name: str = "split") -> DataFrame:
    """Assign rows to parts by a hash of their keys, so that a row's part never changes."""
    u = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) / 1_000_000
    column, total = F.lit(None).cast("string"), 0.0
    bounds = []
    for part, share in parts.items():
        total += share
        bounds.append((part, total))
    for part, bound in reversed(bounds):
        column = F.when(u < bound, part).otherwise(column)
    return df.withColumn(name, F.coalesce(column, F.lit(bounds[-1][0])))


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """standard: mean 0 and population deviation 1; minmax: 0 to 1. No spread gives 0."""
    made = []
    for c in columns:
        made += [F.avg(c), F.stddev_pop(c)] if method == "standard" else [F.min(c), F.max(c) - F.min(c)]
    stats = df.agg(*[m.alias(f"m{i}") for i, m in enumerate(made)]).first()
    centred = {c: F.when(F.lit(bool(stats[2 * i + 1])), (F.col(c) - F.lit(stats[2 * i])) / F.lit(stats[2 * i + 1] or 1.0)).otherwise(F.when(F.col(c).isNotNull(), F.lit(0.0))) for i, c in enumerate(columns)}
    return df.withColumns({f"{c}_scaled": x for c, x in centred.items()})


def impute(df: DataFrame, columns: Sequence[str], method: str = "mean") -> DataFrame:
    """Nulls become the column's mean, median, min or max; a column without values stays null."""
    if method == "median":
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])))
        found = {r["name"]: r["m"] for r in quantiles(long, "name", "value", {"m": 0.5}).collect()}  # a row a column
        stats = [found.get(c) for c in columns]
    else:
        stats = df.agg(*[{"mean": F.avg, "min": F.min, "max": F.max}[method](c).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(stats[i])) for i, c in enumerate(columns)})


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values})


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0]
    rates = counts.select("__v", (F.col("__n") / F.lit(total)).alias(f"{column}_frequency"))
    return df.join(rates, F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """Mean of the target per value, shrunk to the mean of all rows by ``smoothing`` rows; the mean of all for values without a target, null where no row has one."""
    overall = F.lit(df.agg(F.avg(target)).first()[0]).cast("double")
    rates = df.groupBy(F.col(column).alias("__v")).agg(((F.coalesce(F.sum(F.col(target).cast("double")), F.lit(0.0)) + smoothing * overall) / (F.count(target) + smoothing)).alias(f"{column}_target"))
    return df.join(rates, F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def binary_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 of 0/1 columns; ratios over nothing are 0."""
    p, y = F.col(predicted) == 1, F.col(label) == 1
    counts = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("tp", "fp", "fn", "tn", over(tp + tn, tp + fp + fn + tn).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by ranks; equal scores share theirs.

    Scores are counted first; the running sum goes over distinct scores, by ranges of them.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    wins = F.sum(F.col("p") * (F.col("upto") - F.col("n") / 2))
    return running(counts, ["s"], {"upto": ("n", "sum")}).agg((wins / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def regression_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    e = F.col(label) - F.col(predicted)
    mean_square = F.avg(e * e)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(mean_square).alias("rmse"), (1 - mean_square / F.nullif(F.var_pop(label), F.lit(0.0))).alias("r2"))


def stability_index(expected: DataFrame, actual: DataFrame, column: str, edges: Sequence[float], floor: float = 1e-4) -> DataFrame:
    """Population stability index of a column between two tables over given bin edges."""
    number = F.lit(0)
    for e in edges:
        number = number + F.when(F.col(column) >= e, 1).otherwise(0)
    share = lambda df, n: df.where(F.col(column).isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("c")).select("bin", (F.col("c") / F.sum("c").over(Window.partitionBy())).alias(n))
    j = share(expected, "e").join(share(actual, "a"), "bin", "full")
    e, a = F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(floor)), F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(floor))
    return j.agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def largest_gap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic, over the counts of distinct values."""
    counts = a.select(F.col(column).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(F.col(column), F.lit(0), F.lit(1))).where("v IS NOT NULL").groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    upto = running(counts, ["v"], {"fx": ("x", "sum"), "fy": ("y", "sum")})
    whole = upto.agg(F.max("fx").alias("nx"), F.max("fy").alias("ny"))
    return upto.join(F.broadcast(whole)).agg(F.max(F.abs(F.col("fx") / F.nullif("nx", F.lit(0)) - F.col("fy") / F.nullif("ny", F.lit(0)))).alias("ks"))


def backtest_windows(df: DataFrame, ts: str, cutoffs: Sequence[str], horizon_days: int, train_days: int | None = None) -> DataFrame:
    """Rows labelled for each cutoff: fold, and train or test."""
    folds = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.to_timestamp_ntz(F.lit(c)).alias("cut")) for i, c in enumerate(cutoffs)]))
    t = F.col(ts).cast("timestamp_ntz")
    cut = F.col("__fold.cut")
    train = t < cut if train_days is None else (t < cut) & (t >= cut - F.expr(f"interval {train_days} days"))
    test = (t >= cut) & (t < cut + F.expr(f"interval {horizon_days} days"))
    role: Column = F.when(train, "train").when(test, "test")
    return df.withColumn("__fold", folds).withColumn("role", role).where("role IS NOT NULL").withColumn("fold", F.col("__fold.fold")).drop("__fold")


def folds(df: DataFrame, keys: Sequence[str], k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Fold 0 to k - 1 by a hash of the keys; give a group's columns and the group stays together."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Folds in which every label is spread evenly (their numbers differ by one at most)."""
    number = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), *keys), *keys)) - 1
    return df.withColumn(name, F.pmod(number, F.lit(k)).cast("int"))


def lag_features(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    over = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"{c}_lag_{n}": F.lag(c, n).over(over) for c in columns for n in lags})


def ranking_report(df: DataFrame, query: str, rank: str, relevant: str, k: int = 10) -> DataFrame:
    """Mean over queries of NDCG@k, reciprocal rank, average precision@k and precision@k; ranks from 1, relevance 0/1."""
    r, hit = F.col(rank), F.col(relevant).cast("double")
    seen = F.sum(hit).over(Window.partitionBy(query).orderBy(rank))
    top = df.withColumn("__seen", seen).where(r <= k)
    per = top.groupBy(query).agg(
        F.sum(hit / F.log2(r + 1)).alias("dcg"),
        F.min(F.when(hit > 0, r)).alias("first"),
        F.sum(hit * F.col("__seen") / r).alias("ap"),
        F.sum(hit).alias("hits"),
    )
    totals = df.groupBy(query).agg(F.least(F.sum(hit), F.lit(float(k))).alias("best"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("best").cast("int"), F.lit(1))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    over = lambda a, b: F.when(F.col("best") > 0, a / b).otherwise(0.0)
    return per.join(totals, query).agg(
        F.avg(over(F.col("dcg"), ideal)).alias("ndcg"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.avg(over(F.col("ap"), F.col("best"))).alias("map"),
        F.avg(F.col("hits") / k).alias("precision"),
    )


def rates_by_group(df: DataFrame, group: str, label: str, predicted: str) -> DataFrame:
    """Share predicted positive, true and false positive rate of each group (fairness audit)."""
    p, y = F.col(predicted) == 1, F.col(label) == 1
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(p.cast("double")).alias("positive_rate"), F.avg(F.when(y, p.cast("double"))).alias("true_positive_rate"), F.avg(F.when(~y, p.cast("double"))).alias("false_positive_rate"))


def calibration(df: DataFrame, label: str, probability: str, bins: int = 10) -> DataFrame:
    """Mean probability and observed rate of equal-width bins of the probability."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_probability"), F.avg(F.col(label).cast("double")).alias("observed"))


def forecast_report(df: DataFrame, by: Sequence[str], order: str, actual: str, predicted: str) -> DataFrame:
    """MAPE, sMAPE and MASE (against the value before) per series."""
    a, p = F.col(actual), F.col(predicted)
    naive = F.abs(a - F.lag(actual).over(Window.partitionBy(*by).orderBy(order)))
    return df.withColumn("__naive", naive).groupBy(*by).agg(
        F.avg(F.abs(a - p) / F.nullif(F.abs(a), F.lit(0.0))).alias("mape"),
        F.avg(2 * F.abs(a - p) / F.nullif(F.abs(a) + F.abs(p), F.lit(0.0))).alias("smape"),
        (F.avg(F.abs(a - p)) / F.nullif(F.avg("__naive"), F.lit(0.0))).alias("mase"),
    )


def tf_idf(docs: DataFrame, ids: str, tokens: str) -> DataFrame:
    """(id, term, weight): term count times ln((1 + n) / (1 + df)) + 1, for arrays of tokens."""
    n = docs.count()
    counts = docs.select(ids, F.explode(tokens).alias("term")).groupBy(ids, "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = counts.groupBy("term").agg((F.log((1 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    return counts.join(idf, "term").select(ids, "term", (F.col("tf") * F.col("idf")).alias("weight"))


def threshold_scores(df: DataFrame, label: str, probability: str) -> DataFrame:
    """(threshold, precision, recall, f1) at 0.01 to 0.99: a row counts as positive from its threshold on.

    Rows are counted by hundredths first, so the sweep goes over a hundred of them.
    """
    p = F.col(probability)
    hundredth = F.least(F.greatest(F.floor(p * 100 + 1e-9), F.lit(0)), F.lit(100)).cast("int").alias("h")
    cells = df.where(p.isNotNull()).groupBy(hundredth).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    steps = df.sparkSession.range(1, 100).select(F.col("id").cast("int").alias("t"))
    upper = steps.join(F.broadcast(cells), F.col("h") >= F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("fp"))
    every = cells.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pos"))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, pos = F.col("tp"), F.col("fp"), F.col("pos")
    return upper.crossJoin(F.broadcast(every)).select((F.col("t") / 100).alias("threshold"), over(tp, tp + fp).alias("precision"), over(tp, pos).alias("recall"), over(2 * tp, tp + fp + pos).alias("f1"))


def best_threshold(df: DataFrame, label: str, probability: str, metric: str = "f1") -> DataFrame:
    """(threshold, score) of the best precision, recall or F1; the least threshold of equals."""
    if metric not in ("f1", "precision", "recall"):
        raise ValueError(f"unknown metric {metric!r}")
    scores = threshold_scores(df, label, probability)
    best = F.max_by(F.struct("threshold", metric), F.struct(F.col(metric), -F.col("threshold"))).alias("b")
    return scores.agg(best).select("b.threshold", F.col(f"b.{metric}").alias("score"))


def residual_histogram(df: DataFrame, label: str, predicted: str, bins: int) -> DataFrame:
    """(bin, n) of label less prediction, in equal widths between the least and the largest; 0 to bins - 1. Only finite residuals count."""
    e = df.select((F.col(label) - F.col(predicted)).cast("double").alias("e")).where("e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity')")
    low, high = e.agg(F.min("e"), F.max("e")).first()
    width = (high - low) / bins if low is not None else 0.0
    number = F.least(F.floor((F.col("e") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
    return e.groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def durbin_watson(df: DataFrame, label: str, predicted: str, by: Sequence[str], order: str) -> DataFrame:
    """Durbin-Watson statistic of each series' residuals, and whether it lies outside 1.5 to 2.5."""
    e = df.withColumn("__e", F.col(label) - F.col(predicted))
    step = F.col("__e") - F.lag("__e").over(Window.partitionBy(*by).orderBy(order))
    stat = (F.sum(F.col("__d") * F.col("__d")) / F.nullif(F.sum(F.col("__e") * F.col("__e")), F.lit(0.0))).alias("durbin_watson")
    found = e.withColumn("__d", step).groupBy(*by).agg(stat)
    return found.withColumn("outside", (F.col("durbin_watson") < 1.5) | (F.col("durbin_watson") > 2.5))


def prediction_interval(calibration_rows: DataFrame, test: DataFrame, label: str, predicted: str, coverage: float = 0.9) -> DataFrame:
    """(half_width, mean_width, covered): the conformal half width of calibration residuals, and the share of test labels inside.

    The half width is the ceil((n + 1) * coverage)-th smallest absolute residual (the largest if there are too few).
    """
    size = lambda d: d.select(F.abs(F.col(label) - F.col(predicted)).cast("double").alias("r")).where("r IS NOT NULL")
    counts = size(calibration_rows).groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    upto = running(counts, ["r"], {"upto": ("n", "sum")})
    total = upto.agg(F.max("upto").alias("total"))
    rank = F.least(F.ceil((F.col("total") + 1) * coverage), F.col("total"))
    half = upto.crossJoin(F.broadcast(total)).agg(F.min(F.when(F.col("upto") >= rank, F.col("r"))).alias("half_width"))
    return size(test).crossJoin(F.broadcast(half)).groupBy("half_width").agg(F.avg((F.col("r") <= F.col("half_width")).cast("double")).alias("covered")).select("half_width", (2 * F.col("half_width")).alias("mean_width"), "covered")


def walk_forward(df: DataFrame, order: Sequence[str], train: int, test: int, steps: int) -> DataFrame:
    """Rows of each step: ``train`` rows in time order, then the next ``test``; every step begins ``test`` rows later.

    Raises ValueError when the table has fewer than train + test * steps rows.
    """
    first = written(df.orderBy(*order).limit(train + test * steps))
    if first.count() < train + test * steps:
        raise ValueError("too few rows for these windows")
    rows = numbered(first, order, "__n")
    at = F.col("__n") - 1 - F.col("step") * test
    role = F.when((at >= 0) & (at < train), "train").when((at >= train) & (at < train + test), "test")
    return rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("role", role).where("role IS NOT NULL").drop("__n")
