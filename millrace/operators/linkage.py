"""Record linkage and graph walks."""

from __future__ import annotations

import functools
import itertools
import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.storage import rewritten, written


def connected(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): least id of each vertex's component, for edges (a, b) and vertices (id).

    Minimum labels with a jump to the label's own label each round, so long
    chains close in a logarithm of their length.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = vertices.select("id", F.col("id").alias("component"))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        met = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("jump"))
        stepped = rewritten(met.join(jump, "new", "left").select("id", "old", F.least("new", "jump").alias("component")))
        if stepped.where("old <> component").isEmpty():
            return stepped.select("id", "component")
        labels = stepped.select("id", "component")


def _points(texts: Sequence[str], fill: int) -> np.ndarray:
    """Code points of the texts, a row each, filled up to the longest."""
    size = np.array([len(t) for t in texts])
    table = np.full((len(texts), max(4, size.max(initial=0))), fill, np.int32)
    table[np.arange(table.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return table


def jaro_winkler(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Jaro similarity of each pair, raised by a common prefix of up to four characters; two empty texts are equal.

    All pairs take a step at once: the k-th character of every left text gets the first
    free equal character within reach in its right text.
    """
    a, b = _points(left, -1), _points(right, -2)
    n_a, n_b = (a >= 0).sum(axis=1), (b >= 0).sum(axis=1)
    reach = np.maximum(np.maximum(n_a, n_b) // 2 - 1, 0)[:, None]
    places, free, found = np.arange(b.shape[1]), b >= 0, np.zeros(a.shape, bool)
    for k in range(n_a.max(initial=0)):
        fits = free & (b == a[:, k : k + 1]) & (np.abs(places - k) <= reach)
        found[:, k] = fits.any(axis=1)
        rows = np.flatnonzero(found[:, k])
        free[rows, fits[rows].argmax(axis=1)] = False
    met = np.maximum(found.sum(axis=1), 1)
    # row by row, both masks hold the same number of characters
    moved = np.bincount(np.nonzero(found)[0], weights=(a[found] != b[(b >= 0) & ~free]).astype(float), minlength=len(a))
    jaro = (met / np.maximum(n_a, 1) + met / np.maximum(n_b, 1) + 1 - moved / 2 / met) / 3 * found.any(axis=1)
    start = np.cumprod(a[:, :4] == b[:, :4], axis=1).sum(axis=1)
    return np.where(n_a + n_b == 0, 1.0, jaro + start * 0.1 * (1 - jaro))


@F.pandas_udf(T.DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    """Pairs are taken together by the power of two of their longer text, so that a long one does not widen all; null counts as empty."""
    a, b = a.fillna("").to_numpy(), b.fillna("").to_numpy()
    power = np.frexp([max(len(x), len(y)) for x, y in zip(a, b, strict=True)])[1]
    out = np.empty(len(a))
    for p in np.unique(power):
        own = np.flatnonzero(power == p)
        out[own] = jaro_winkler(a[own], b[own])
    return pd.Series(out)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


#: Values of a block that are compared with as many others in one group.
GROUP = 1000


def _length_classes(threshold: float, metric: str) -> float | None:
    """How many times longer one of two similar values may be; None if lengths rule nothing out."""
    # A Jaro similarity j needs 3 j - 1 <= m / a + m / b for m common characters; a common start adds up to 0.4 (1 - j).
    shortest = threshold if metric == "levenshtein" else 3 * (threshold - 0.4) / 0.6 - 2
    return 1 / shortest if 0 < shortest < 1 else None


def _block_pairs(values: DataFrame, ratio: float | None) -> DataFrame:
    """Rows x and y of every two values (v, id, block) of a block whose lengths are within the ratio, each pair once.

    Values stand in classes of lengths; a class meets itself and the next. Classes of very many values are dealt to
    groups of some ``GROUP``, and every two groups meet under a key of their own, so a block is worked on by many tasks.
    """
    kind = F.lit(0) if ratio is None else F.floor(F.log(F.greatest(F.length("v"), F.lit(1)) * 1.0) / math.log(ratio) + 1e-9)
    classed = values.withColumn("c", kind.cast("int"))
    sizes = written(classed.groupBy("block", "c").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("k")))
    dealt = written(classed.join(sizes, ["block", "c"]).withColumn("g", F.pmod(F.xxhash64("v"), F.col("k")).cast("int")).drop("k"))
    other = sizes.select(F.col("block").alias("o_block"), F.col("c").alias("o_c"), F.col("k").alias("o_k"))
    span = lambda first: F.explode(F.sequence(first, F.col("o_k") - 1))
    met = []
    for step in (0, 1):
        with_next = dealt.join(other, (F.col("block") == F.col("o_block")) & (F.col("c") + step == F.col("o_c")))
        x = with_next.select("block", "c", "g", span(F.col("g") if step == 0 else F.lit(0)).alias("h"), F.col("v").alias("x_v"), F.col("id").alias("x_id"))
        before = dealt.join(other, (F.col("block") == F.col("o_block")) & (F.col("c") - step == F.col("o_c")))
        upto = F.col("g") if step == 0 else F.col("o_k") - 1
        y = before.select("block", (F.col("c") - step).alias("c"), F.explode(F.sequence(F.lit(0), upto)).alias("g"), F.col("g").alias("h"), F.col("v").alias("y_v"), F.col("id").alias("y_id"))
        pairs = x.join(y, ["block", "c", "g", "h"])
        met.append(pairs.where("g < h OR x_id < y_id") if step == 0 else pairs)
    both = met[0].union(met[1]) if ratio is not None else met[0]
    swap = F.col("x_id") > F.col("y_id")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return both.select(pick("x_id", "y_id").alias("a"), pick("y_id", "x_id").alias("b"), pick("x_v", "y_v").alias("av"), pick("y_v", "x_v").alias("bv"))


def fuzzy_pairs(df: DataFrame, key: str, column: str, prefix: int, threshold: float, metric: str = "levenshtein") -> DataFrame:
    """(a, b, score) of rows in one block (same first letters) that are similar enough; equal values meet once.

    Values are compared once each; the rows that share a value are linked to its least row. Values meet only where their lengths
    allow the threshold, group by group, so that no block is one task's.
    """
    value = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("none")))
    rows = df.select(F.col(key).alias("id"), value.alias("v"))
    values = rows.groupBy("v").agg(F.min("id").alias("id")).withColumn("block", F.substring("v", 1, prefix))
    score = edit_similarity(F.col("av"), F.col("bv")) if metric == "levenshtein" else jaro_winkler_column(F.col("av"), F.col("bv"))
    near = _block_pairs(values, _length_classes(threshold, metric))
    pairs = near.select("a", "b", score.alias("score")).where(F.col("score") >= threshold)
    same = rows.join(values.select("v", F.col("id").alias("head")), "v").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    return pairs.union(same)


def fuzzy_deduplicate(df: DataFrame, key: str, column: str, prefix: int = 3, threshold: float = 0.8, metric: str = "levenshtein") -> DataFrame:
    """The row of least key of each group of similar values."""
    pairs = fuzzy_pairs(df, key, column, prefix, threshold, metric)
    groups = connected(pairs.select("a", "b"), df.select(F.col(key).alias("id")))
    return df.join(groups.where("id = component").select(F.col("id").alias(key)), key, "left_semi")


@dataclass(frozen=True)
class Field:
    """Agreement odds of one compared column: m among matches, u among others."""

    name: str
    m: float
    u: float


#: Pairs of rows that agree in a block's columns which one task lists, and rows of a side in it.
PAIRS, SIDE = 1 << 24, 1 << 12


def _agree(name: str) -> Column:
    return F.coalesce(F.col(f"l.{name}") == F.col(f"r.{name}"), F.lit(False))


def _dealt_join(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows l of ``a`` and r of ``b`` that agree in the columns, all of them.

    Few values make many pairs of few rows, so partitions by the size of the input would leave the pairs to a few tasks. Rows of a value with
    many pairs are dealt to parts, every two of which meet under a key of their own.
    """
    counts = [x.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for x, n in ((a, "__n"), (b, "__m"))]
    parts = lambda n: F.when(F.col("__n") * F.col("__m") > PAIRS // 16, F.ceil(F.col(n) / SIDE)).otherwise(1).cast("int")
    met = written(counts[0].join(counts[1], list(on)).select(*on, (F.col("__n").cast("double") * F.col("__m")).alias("__pairs"), parts("__n").alias("__i"), parts("__m").alias("__j")))
    total = met.agg(F.sum("__pairs").alias("pairs"), F.sum(F.col("__i") * F.col("__j")).alias("parts")).first()
    same = lambda names: functools.reduce(operator.and_, [F.col(f"l.{n}") == F.col(f"r.{n}") for n in names])
    if (total["pairs"] or 0) <= PAIRS:
        return a.alias("l").join(b.alias("r"), same(on))
    partitions = min(total["parts"], math.ceil(total["pairs"] / PAIRS) * 4)
    keys = [*on, "__g", "__h"]

    def dealt(x: DataFrame, own: str, parts: str, other: str, others: str) -> DataFrame:
        # By a hash, so that a task that runs again deals its rows alike.
        rows = x.join(met, list(on)).withColumn(own, F.pmod(F.xxhash64(x.columns[0], F.lit(7)), F.col(parts)).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return rows.select(*x.columns, "__g", "__h").repartition(partitions, *keys)

    return dealt(a, "__g", "__i", "__h", "__j").alias("l").join(dealt(b, "__h", "__j", "__g", "__i").alias("r").hint("merge"), same(keys))


def _scored(hit: DataFrame, fields: Sequence[Field], agreed: Sequence[str], status) -> DataFrame:
    """(left_id, right_id, score, status) of joined rows that agree in some fields: constants, picked by the agreement of the others.

    A null on either side disagrees. status: of a score.
    """
    open_ = [f.name for f in fields if f.name not in agreed]
    cases = []
    for found in itertools.product((True, False), repeat=len(open_)):
        yes = {*agreed, *(n for n, same in zip(open_, found, strict=True) if same)}
        total = 0.0
        for f in fields:
            total += math.log2(f.m / f.u) if f.name in yes else math.log2((1 - f.m) / (1 - f.u))
        case = functools.reduce(operator.and_, [_agree(n) if same else ~_agree(n) for n, same in zip(open_, found, strict=True)], F.lit(True))
        cases.append((case, total))
    flat = lambda of: functools.reduce(lambda made, c: made.when(c[0], of(c[1])), cases[1:-1], F.when(cases[0][0], of(cases[0][1]))).otherwise(of(cases[-1][1])) if len(cases) > 1 else F.lit(of(cases[0][1]))
    return hit.select("left_id", "right_id", flat(lambda total: total).alias("score"), flat(status).alias("status"))


def link(left: DataFrame, right: DataFrame, fields: Sequence[Field], ids: tuple[str, str], match: float, review: float, blocks: Sequence[str] | None = None) -> DataFrame:
    """(left_id, right_id, score, status) of the pairs that agree on at least one block column.

    blocks: columns to meet on (default: all fields). A pair that agrees on none of the
    fields has the least score of all, so it is a match only if everything is;
    such pairs are not listed.
    """
    blocks = list(blocks or [f.name for f in fields])
    a = left.select(F.col(ids[0]).alias("left_id"), *[f.name for f in fields])
    b = right.select(F.col(ids[1]).alias("right_id"), *[f.name for f in fields])
    status = lambda score: "match" if score >= match else "review" if score >= review else "non_match"
    parts = []
    for i, k in enumerate(blocks):
        hit = _dealt_join(a, b, [k])
        # listed by the first block that the pair agrees on
        for earlier in blocks[:i]:
            hit = hit.where(~_agree(earlier))
        parts.append(_scored(hit, fields, [k], status))
    return functools.reduce(DataFrame.union, parts)


def link_candidates(left: DataFrame, right: DataFrame, fields: Sequence[Field], ids: tuple[str, str], match: float, review: float) -> DataFrame:
    """(left_id, right_id, score, status) of the pairs that reach the review score, each once.

    Rows meet on the least sets of fields whose agreement is enough for it, all fields of a set together, so a field of few
    values alone brings no pairs unless it is enough alone. Nulls agree with nothing. Raises ValueError when no agreement is needed.
    """
    names = {f.name: f for f in fields}
    up = {n: math.log2(f.m / f.u) for n, f in names.items()}
    down = {n: math.log2((1 - f.m) / (1 - f.u)) for n, f in names.items()}
    score = lambda own: sum(up[n] if n in own else down[n] for n in names)
    reaching = [frozenset(c) for k in range(len(names) + 1) for c in itertools.combinations(names, k) if score(c) >= review]
    least = [s for s in reaching if not any(o < s for o in reaching)]
    if frozenset() in least:
        raise ValueError("pairs that agree in nothing would reach the review score")
    a = left.select(F.col(ids[0]).alias("left_id"), *names)
    b = right.select(F.col(ids[1]).alias("right_id"), *names)
    agree = lambda s: functools.reduce(operator.and_, [_agree(n) for n in sorted(s)])
    parts = []
    for i, own in enumerate(least):
        hit = _dealt_join(a, b, sorted(own))
        for earlier in least[:i]:
            hit = hit.where(~agree(earlier))
        parts.append(_scored(hit, fields, sorted(own), lambda score: "match" if score >= match else "review").where(F.col("score") >= review))
    if not parts:
        parts = [a.crossJoin(b).limit(0).select("left_id", "right_id", F.lit(0.0).alias("score"), F.lit("review").alias("status"))]
    return functools.reduce(DataFrame.union, parts)


def breadth_first(edges: DataFrame, starts: DataFrame, depth: int, undirected: bool = False) -> DataFrame:
    """(id, distance) of all nodes within ``depth`` steps of the starts, for edges (a, b)."""
    steps = edges.select("a", "b")
    steps = (steps.union(edges.select("b", "a")) if undirected else steps).distinct()
    seen = starts.select("id").distinct().withColumn("distance", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        reached = front.join(steps, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        front = written(reached.join(seen, "id", "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen
