"""Models fitted on tables: anomaly scores by isolation trees, clusters, recommendations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.functions.ranges import numbered
from millrace.functions.storage import written

_TREE = "tree int, node int, feature int, cut double, depth int, size int"


def _path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth at which a search among n values ends."""
    n = np.maximum(np.asarray(n, np.float64), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n > 1, 1.0, 0.0))


def _grown(x: np.ndarray, rng: np.random.Generator, most: int) -> list[tuple[int, int, float, int, int]]:
    """(node, feature, cut, depth, size) of one tree; the halves of node i are 2 i + 1 and 2 i + 2, a leaf's feature is -1."""
    out, todo = [], [(0, 0, np.arange(len(x)))]
    while todo:
        node, depth, own = todo.pop()
        low, high = x[own].min(axis=0), x[own].max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth >= most or len(own) < 2 or not len(wide):
            out.append((node, -1, 0.0, depth, len(own)))
            continue
        f = int(rng.choice(wide))
        cut = float(rng.uniform(low[f], high[f]))
        left = x[own, f] < cut
        if not left.any():  # the cut fell on the least value
            cut, left = float(high[f]), x[own, f] < high[f]
        out.append((node, f, cut, depth, len(own)))
        todo += [(2 * node + 1, depth + 1, own[left]), (2 * node + 2, depth + 1, own[~left])]
    return out


def isolation_trees(df: DataFrame, ids: Sequence[str], features: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 7) -> DataFrame:
    """(tree, node, feature, cut, depth, size): trees of random cuts, each grown in a task of its own from ``sample`` rows.

    Samples follow each other through the ``trees * sample`` rows of least seeded hash of their ids and features, and begin again where there are fewer: the same
    rows give the same trees, however they are partitioned. Rows with a feature that is no finite number are not sampled.
    """
    numbers = [F.col(f).cast("double") for f in features]
    whole = F.lit(True)
    for n in numbers:
        whole = whole & F.coalesce(~F.isnan(n) & (F.abs(n) < float("inf")), F.lit(False))
    place = F.xxhash64(F.lit(seed), *ids, *numbers).alias("h")
    rows = df.where(whole).select(place, *[n.alias(f"x{i}") for i, n in enumerate(numbers)])
    names = [f"x{i}" for i in range(len(numbers))]
    drawn = written(rows.orderBy("h", *names).limit(trees * sample))
    pool = max(drawn.count(), 1)
    takes = lambda t: F.pmod(F.col("n") - 1 - t * sample, F.lit(pool)) < sample
    dealt = numbered(drawn, ["h", *names], "n").withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), takes)))
    most = max(1, int(np.ceil(np.log2(max(sample, 2)))))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values(["h", *names])
        tree = int(own["tree"].iloc[0])
        nodes = _grown(own[names].to_numpy(np.float64), np.random.default_rng([seed, tree]), most)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "cut", "depth", "size"])

    return dealt.groupBy("tree").applyInPandas(grow, _TREE)


def anomaly_scores(df: DataFrame, ids: Sequence[str], features: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 7, name: str = "anomaly") -> DataFrame:
    """``df`` with a score from 0 to 1: near 1 where few random cuts part a row from the sample, about 0.5 or less for ordinary rows.

    Trees hold at most ``2 * sample`` nodes each and are sent to every executor; rows are scored in batches. A row with a feature that is no
    finite number has no score; a table without sampled rows gives nulls.
    """
    grown = isolation_trees(df, ids, features, trees, sample, seed).toPandas()
    forest = []
    for _, own in grown.groupby("tree"):
        table = {int(n): (int(f), float(c), float(d) + float(_path_length(s))) for n, f, c, d, s in own[["node", "feature", "cut", "depth", "size"]].itertuples(index=False)}
        order = {n: i for i, n in enumerate(sorted(table))}
        at = sorted(table)
        forest.append((np.array([table[n][0] for n in at]), np.array([table[n][1] for n in at]), np.array([table[n][2] for n in at]), np.array([order.get(2 * n + 1, 0) for n in at]), np.array([order.get(2 * n + 2, 0) for n in at]), int(own.loc[own["node"] == 0, "size"].iloc[0])))
    norm = float(_path_length(np.mean([f[5] for f in forest]))) if forest else 0.0
    sent = df.sparkSession.sparkContext.broadcast((forest, norm))
    n = len(df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, norm = sent.value
        for batch in batches:
            x = np.column_stack([batch.column(n + i).to_numpy(zero_copy_only=False) for i in range(len(features))]).astype(np.float64) if batch.num_rows else np.zeros((0, len(features)))
            good = np.isfinite(x).all(axis=1) & bool(forest) & (norm > 0)
            depth, own = np.zeros(len(x)), x[good]
            for feature, cut, length, left, right, _ in forest:
                node = np.zeros(len(own), int)
                while (inner := np.flatnonzero(feature[node] >= 0)).size:
                    at = node[inner]
                    node[inner] = np.where(own[inner, feature[at]] < cut[at], left[at], right[at])
                depth[good] += length[node]
            value = np.exp2(-depth / max(len(forest), 1) / norm) if norm > 0 else depth
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(value, mask=~good)], names=schema.names)

    return df.select("*", *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)]).mapInArrow(score, schema)


def clusters(df: DataFrame, features: Sequence[str], k: int, seed: int = 7, scaled: bool = True, name: str = "cluster") -> DataFrame:
    """``df`` with the cluster of each row by k-means over (standardised) features; rows with a null or NaN feature have none."""
    numbers = df.withColumns({f"__x{i}": F.col(f).cast("double") for i, f in enumerate(features)})
    inputs = [f"__x{i}" for i in range(len(features))]
    known = numbers.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in inputs))
    packed = VectorAssembler(inputCols=inputs, outputCol="__raw").transform(known)
    column = "__raw"
    if scaled:
        packed, column = StandardScaler(withMean=True, withStd=True, inputCol="__raw", outputCol="__v").fit(packed).transform(packed), "__v"
    found = KMeans(k=k, seed=seed, featuresCol=column, predictionCol=name).fit(packed).transform(packed).select(*df.columns, name)
    rest = numbers.where(" OR ".join(f"{c} IS NULL OR isnan({c})" for c in inputs)).select(*df.columns, F.lit(None).cast("int").alias(name))
    return found.union(rest)


def recommendations(df: DataFrame, user: str, item: str, rating: str, k: int, rank: int = 8, rounds: int = 10, seed: int = 7) -> DataFrame:
    """(user, item, score, place): the k best items of each user by alternating least squares; ids are whole numbers, rows with nulls are left out."""
    known = df.select(F.col(user).cast("int").alias("u"), F.col(item).cast("int").alias("i"), F.col(rating).cast("float").alias("r")).where("u IS NOT NULL AND i IS NOT NULL AND r IS NOT NULL")
    model = ALS(rank=rank, maxIter=rounds, seed=seed, userCol="u", itemCol="i", ratingCol="r", coldStartStrategy="drop").fit(known)
    best = model.recommendForAllUsers(k).select(F.col("u").alias(user), F.posexplode("recommendations").alias("p", "b"))
    return best.select(user, F.col("b.i").alias(item), F.col("b.rating").alias("score"), (F.col("p") + 1).alias("place"))
