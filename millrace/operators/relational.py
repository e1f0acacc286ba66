"""Row and table transforms: every one is DataFrame in, DataFrame out, and lazy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.functions.columns import all_same, checked
from millrace.functions.storage import written


@dataclass(frozen=True)
class Agg:
    """One aggregate: function of a source column.

    order: column that gives rows their place, for first and last.
    null_sum: a sum over nothing is null instead of 0.
    """

    source: str
    function: str
    order: str | None = None
    null_sum: bool = False

    def column(self) -> Column:
        x = F.col(self.source)
        if self.function in ("first", "last"):
            if self.order is None:
                raise ValueError(f"{self.function} needs an order column")
            pick = F.min_by if self.function == "first" else F.max_by
            return pick(F.struct(x.alias("x")), F.col(self.order))["x"]
        if self.function == "sum":
            return F.sum(x) if self.null_sum else F.coalesce(F.sum(x), F.lit(0))
        simple = {
            "mean": F.avg,
            "min": F.min,
            "max": F.max,
            "count": F.count,
            "count_distinct": F.countDistinct,
            "any": F.bool_or,
            "all": F.bool_and,
        }
        if self.function not in simple:
            raise ValueError(f"unknown aggregate: {self.function}")
        return simple[self.function](x)


def aggregate(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Agg | Column | str]) -> DataFrame:
    """Group and aggregate; values may be Agg, Columns or SQL text. A null is a group of its own."""
    made = []
    for name, agg in aggs.items():
        column = agg.column() if isinstance(agg, Agg) else F.expr(agg) if isinstance(agg, str) else agg
        made.append(column.alias(name))
    return df.groupBy(*by).agg(*made) if by else df.agg(*made)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns; unknown names and collisions raise."""
    if missing := [c for c in mapping if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    after = [mapping.get(c, c) for c in df.columns]
    if len(set(after)) < len(after):
        raise ValueError("two columns would have the same name")
    return df.withColumnsRenamed(dict(mapping))


def cast(df: DataFrame, types: Mapping[str, str], lenient: bool = False) -> DataFrame:
    """Change types; a value that does not fit raises, or becomes null if lenient."""
    change = (lambda c, t: F.col(c).try_cast(t)) if lenient else (lambda c, t: F.col(c).cast(t))
    return df.withColumns({c: change(c, t) for c, t in types.items()})


@dataclass(frozen=True)
class NormalizeRule:
    """Steps for a text column: trim, collapse blanks, case, words that mean null."""

    strip: bool = True
    collapse: bool = True
    case: str | None = None
    nulls: tuple[str, ...] = ()


def _title(x: Column) -> Column:
    """Upper case after every character that is no letter, lower case elsewhere."""
    letters = F.split(F.lower(x), "")
    before = F.concat(F.array(F.lit("")), letters)
    cased = F.zip_with(letters, F.slice(before, F.lit(1), F.greatest(F.size(letters), F.lit(1))), lambda c, p: F.when(p.rlike(r"^\p{L}$"), c).otherwise(F.upper(c)))
    return F.array_join(cased, "")


def normalize(df: DataFrame, rules: Mapping[str, NormalizeRule]) -> DataFrame:
    """Clean text columns by rule."""
    out = {}
    for name, rule in rules.items():
        x = F.col(name)
        x = F.regexp_replace(x, r"\s+", " ") if rule.collapse else x
        x = F.regexp_replace(x, r"^\s+|\s+$", "") if rule.strip else x
        if rule.nulls:
            x = F.when(F.lower(x).isin([n.lower() for n in rule.nulls]), None).otherwise(x)
        x = {"lower": F.lower, "upper": F.upper, "title": _title, None: lambda c: c}[rule.case](x)
        out[name] = x
    return df.withColumns(out)


def deduplicate(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order; null keys are equal."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


JOINS = {"inner", "left", "right", "full", "left_semi", "left_anti", "right_semi", "right_anti", "cross"}


def join(left: DataFrame, right: DataFrame, on: Sequence[str] | str | Column, how: str = "inner", null_equal: bool = False, suffix: str = "_right") -> DataFrame:
    """Join on columns of the same name, or on a condition over aliases l and r.

    Columns of the right side that clash get the suffix. right_semi and
    right_anti keep rows of the right side. null_equal: null keys match.
    """
    if how not in JOINS:
        raise ValueError(f"unknown join: {how}")
    if how in ("right_semi", "right_anti"):
        return join(right, left, on, how.replace("right", "left"), null_equal, suffix)
    a, b = left.alias("l"), right.alias("r")
    if how == "cross":
        condition, shared = F.lit(True), []
    elif isinstance(on, (str, Column)):
        condition, shared = F.expr(on) if isinstance(on, str) else on, []
    else:
        shared = list(on)
        condition = all_same("l", "r", shared) if null_equal else F.lit(True)
        if not null_equal:
            for k in shared:
                condition = condition & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    joined = a.join(b, condition, how if how != "cross" else "inner")
    if how in ("left_semi", "left_anti"):
        return joined
    keys = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in shared]
    own = [F.col(f"l.{c}").alias(c) for c in left.columns if c not in shared]
    rest = [F.col(f"r.{c}").alias(c + suffix if c in left.columns else c) for c in right.columns if c not in shared]
    return joined.select(*keys, *own, *rest)


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left join with the first match of a lookup table; null keys match null keys."""
    first = deduplicate(table.select(*dict.fromkeys([*keys, *columns, *order])), keys, order).select(*keys, *columns)
    return join(df, first, keys, "left", null_equal=True)


def range_lookup(df: DataFrame, ranges: DataFrame, bounds: Mapping[str, tuple[str, str]], columns: Sequence[str]) -> DataFrame:
    """Left join where each value lies between a range's bounds, both included; several matches multiply rows.

    For a small table of ranges, which Spark sends to every executor; ``grid_lookup`` is the way for large ones.
    """
    condition = F.lit(True)
    for value, (low, high) in bounds.items():
        condition = condition & F.col(f"l.{value}").between(F.col(f"r.{low}"), F.col(f"r.{high}"))
    return df.alias("l").join(ranges.alias("r"), condition, "left").select("l.*", *[F.col(f"r.{c}") for c in columns])


def grid_lookup(df: DataFrame, ranges: DataFrame, bounds: Mapping[str, tuple[str, str]], columns: Sequence[str], widths: Mapping[str, float]) -> DataFrame:
    """``range_lookup`` over several axes at once by an equi-join on cells of a grid, ``widths`` wide on each axis.

    A box is copied to each cell that it touches: take widths near the boxes' own. Rows without a value on an axis match nothing.
    """
    cell = lambda c, axis: F.floor(c / F.lit(widths[axis])).cast("long")
    spread, left, condition = ranges, df, F.lit(True)
    for i, (axis, (low, high)) in enumerate(bounds.items()):
        spread = spread.where(F.col(low) <= F.col(high)).withColumn(f"__cell{i}", F.explode(F.sequence(cell(F.col(low), axis), cell(F.col(high), axis))))
        left = left.withColumn(f"__cell{i}", cell(F.col(axis), axis))
        condition = condition & (F.col(f"l.__cell{i}") == F.col(f"r.__cell{i}")) & F.col(f"l.{axis}").between(F.col(f"r.{low}"), F.col(f"r.{high}"))
    return left.alias("l").join(spread.alias("r"), condition, "left").select(*[F.col(f"l.{c}") for c in df.columns], *[F.col(f"r.{c}") for c in columns])


def bucketed_range_lookup(df: DataFrame, ranges: DataFrame, value: str, low: str, high: str, columns: Sequence[str], width: float) -> DataFrame:
    """The same for one value by an equi-join on buckets of ``width``: no nested loop over large tables.

    A range is copied to each bucket that it touches.
    """
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("__bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    left = df.withColumn("__bucket", bucket(F.col(value))).alias("l")
    condition = (F.col("l.__bucket") == F.col("r.__bucket")) & F.col(f"l.{value}").between(F.col(f"r.{low}"), F.col(f"r.{high}"))
    return left.join(spread.alias("r"), condition, "left").select(*[F.col(f"l.{c}") for c in df.columns], *[F.col(f"r.{c}") for c in columns])


def prefix_lookup(df: DataFrame, table: DataFrame, value: str, prefix: str, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Left join where the value begins with the table's prefix; several matches multiply rows.

    An equi-join on the value's beginnings of the lengths that prefixes have. key: columns that go with a row; they need not tell rows
    apart, as a row's own beginnings travel with it. Null values match nothing.
    """
    lengths = sorted(r[0] for r in table.where(F.col(prefix).isNotNull()).select(F.length(prefix)).distinct().collect())
    cut = [F.when(F.length(value) >= n, F.substring(F.col(value), 1, n)) for n in lengths]
    tried = F.array_compact(F.array(*cut)) if cut else F.array().cast("array<string>")
    # Each prefix that stands in the table once; a beginning that does not is dropped by the first join, before rows meet.
    known = table.where(F.col(prefix).isNotNull()).select(F.col(prefix).alias("__prefix")).distinct()
    numbered = written(df.withColumn("__row", F.monotonically_increasing_id()))
    beginnings = numbered.select("__row", F.explode(tried).alias("__prefix")).join(known, "__prefix", "left_semi")
    hits = beginnings.join(table.select(F.col(prefix).alias("__prefix"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)]), "__prefix").drop("__prefix")
    others = [c for c in df.columns if c not in key]
    return numbered.join(hits, "__row", "left").select(*key, *others, *[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)])


def pivot(df: DataFrame, index: Sequence[str], columns: str, values: str, function: str = "sum", names: Sequence | None = None) -> DataFrame:
    """Spread a column's values to columns; give ``names`` to save the pass that finds them."""
    grouped = df.groupBy(*index)
    spread = grouped.pivot(columns, list(names)) if names is not None else grouped.pivot(columns)
    return spread.agg(getattr(F, {"mean": "avg"}.get(function, function))(values))


def unpivot(df: DataFrame, index: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(index), list(columns), name, value)


def window_calc(df: DataFrame, expressions: Mapping[str, Column | str], partition: Sequence[str] = (), order: Sequence[str] = (), rows: tuple[int, int] | None = None) -> DataFrame:
    """Add columns computed over a window."""
    over = Window.partitionBy(*partition)
    over = over.orderBy(*order) if order else over
    over = over.rowsBetween(*rows) if rows else over
    return df.withColumns({n: (F.expr(e) if isinstance(e, str) else e).over(over) for n, e in expressions.items()})


def top_k(df: DataFrame, k: int, order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    """The first k rows, of all or of each group."""
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def rollup(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Agg | str], cube: bool = False) -> DataFrame:
    """Subtotals along (rollup) or over all subsets of (cube) the grouping columns."""
    made = [(a.column() if isinstance(a, Agg) else F.expr(a)).alias(n) for n, a in aggs.items()]
    return (df.cube(*by) if cube else df.rollup(*by)).agg(*made)


def staging(df: DataFrame, columns: Mapping[str, str], loaded_at: Column | None = None, stamp: str = "_loaded_at") -> DataFrame:
    """Project and rename source columns, with a load stamp."""
    return df.select(*[F.col(s).alias(t) for s, t in columns.items()], (loaded_at if loaded_at is not None else F.current_timestamp()).alias(stamp))


def mart(df: DataFrame, by: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
    """Group by columns (none: all rows) with SQL metric expressions."""
    return aggregate(df, checked(by), metrics)


def metric(df: DataFrame, name: str, aggregation: str, value: str = "", dimensions: Sequence[str] = (), numerator: str = "", denominator: str = "") -> DataFrame:
    """One named metric: sum, count, avg, or the ratio of two sums (null over a sum of 0)."""
    made = {
        "sum": lambda: F.sum(value),
        "count": lambda: F.count(value),
        "avg": lambda: F.avg(value),
        "ratio": lambda: F.sum(numerator).cast("double") / F.nullif(F.sum(denominator), F.lit(0)),
    }[aggregation]()
    grouped = df.groupBy(*dimensions) if dimensions else df.groupBy()
    return grouped.agg(made.alias(name))
