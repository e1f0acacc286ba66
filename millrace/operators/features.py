"""Feature columns."""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.functions.columns import floor_mod, text_of
from millrace.functions.ranges import running

_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: a.cast("double") / b,
    ast.FloorDiv: lambda a, b: F.floor(a / b),
    ast.Mod: floor_mod,
    ast.Pow: F.pow,
}
_COMPARE = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}


def compile_expression(text: str, columns: Sequence[str]) -> Column:
    """A Python arithmetic or logical expression over column names as a Column.

    ``/`` is always a float, ``//`` and ``%`` follow the divisor's sign,
    comparisons chain. Anything else (calls, attributes, unknown names) raises ValueError.
    """

    def visit(node: ast.AST) -> Column:
        match node:
            case ast.Expression():
                return visit(node.body)
            case ast.Constant(value=v) if v is None or isinstance(v, (bool, int, float, str)):
                return F.lit(v)
            case ast.Name(id=name) if name in columns:
                return F.col(name)
            case ast.BinOp() if type(node.op) in _BINARY:
                return _BINARY[type(node.op)](visit(node.left), visit(node.right))
            case ast.UnaryOp(op=ast.USub()):
                return -visit(node.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return visit(node.operand)
            case ast.UnaryOp(op=ast.Not()):
                return ~visit(node.operand)
            case ast.BoolOp():
                parts = [visit(v) for v in node.values]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(node.op, ast.And) else out | p
                return out
            case ast.Compare() if all(type(o) in _COMPARE for o in node.ops):
                sides = [visit(x) for x in (node.left, *node.comparators)]
                out = F.lit(True)
                for a, op, b in zip(sides, node.ops, sides[1:]):
                    out = out & _COMPARE[type(op)](a, b)
                return out
            case ast.IfExp():
                return F.when(visit(node.test), visit(node.body)).otherwise(visit(node.orelse))
        raise ValueError(f"not allowed in an expression: {ast.dump(node)[:60]}")

    return visit(ast.parse(text, mode="eval"))


def derive(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """Add computed columns one after the other; later ones see earlier ones."""
    for name, text in expressions.items():
        df = df.withColumn(name, compile_expression(text, df.columns))
    return df


def bin_equal_width(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Add {column}_bin, 1 to bins, of equal widths between least and largest."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    width = (high - low) / bins if low is not None else 0
    number = F.lit(1) if not width else F.least(F.floor((F.col(column) - low) / width) + 1, F.lit(bins))
    return df.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), number).cast("int"))


def bin_quantile(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Add {column}_bin by edges at the values of rank int(b * n / bins); right-open but for the last bin.

    The edges come from counts per value and their running sum by ranges, not from one sorted list.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    upto = running(counts, ["v"], {"upto": ("n", "sum")})
    ranks = [min(int(b * n / bins), n - 1) for b in range(1, bins)]
    edges = upto.agg(*[F.min(F.when(F.col("upto") > r, F.col("v"))) for r in ranks]).first() if n and ranks else []
    number = F.lit(1)
    for e in edges:
        number = number + F.when(F.col(column) >= e, 1).otherwise(0)
    return df.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), number).cast("int"))


def hash_columns(df: DataFrame, columns: Sequence[str], algorithm: str = "sha256") -> DataFrame:
    """Replace values by the digest of their text; null has the digest of the word None."""
    make = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "md5": F.md5, "sha1": F.sha1}[algorithm]
    return df.withColumns({c: make(text_of(F.col(c))) for c in columns})


def date_parts(df: DataFrame, column: str, parts: Sequence[str]) -> DataFrame:
    """Add {column}_{part}; weekday counts from Monday, 0."""
    make = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": F.weekday, "quarter": F.quarter}
    return df.withColumns({f"{column}_{p}": make[p](column) for p in parts})


def clean_strings(df: DataFrame, columns: Sequence[str], lowercase: bool = True, strip: bool = True, punctuation: bool = True, form: str | None = None) -> DataFrame:
    """Normalise text: Unicode form (in Arrow batches), case, ASCII punctuation, blanks."""

    @F.pandas_udf("string")
    def to_form(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    out = {}
    for c in columns:
        x = to_form(F.col(c)) if form else F.col(c)
        x = F.lower(x) if lowercase else x
        x = F.regexp_replace(x, r"[!-/:-@\[-`{-~]", "") if punctuation else x
        out[c] = F.trim(x) if strip else x
    return df.withColumns(out)


def token_count(df: DataFrame, column: str, name: str = "token_count") -> DataFrame:
    """Words between white space; 0 for null or blank."""
    return df.withColumn(name, F.coalesce(F.regexp_count(F.col(column), F.lit(r"\S+")), F.lit(0)).cast("long"))


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """Products of 2 to ``degree`` of the columns, with repetition, named a*b; a null factor gives null."""
    made = {}
    for n in range(2, degree + 1):
        for factors in combinations_with_replacement(columns, n):
            product = F.col(factors[0]).cast("double")
            for c in factors[1:]:
                product = product * F.col(c)
            made["*".join(factors)] = product
    return df.withColumns(made)


def interaction_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Products of pairs of columns, named a_x_b."""
    return df.withColumns({f"{a}_x_{b}": F.col(a).cast("double") * F.col(b) for a, b in pairs})


def _bucket(text: Column, n: int) -> Column:
    """A number below n from the first 32 bits of a text's MD5 digest."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def hash_encode(df: DataFrame, column: str, n: int) -> DataFrame:
    """Replace a category by n columns {column}_hash_{i}: 1 at its hash bucket; null has the word None's."""
    bucket = _bucket(text_of(F.col(column)), n)
    return df.select(*[c for c in df.columns if c != column], *[(bucket == i).cast("int").alias(f"{column}_hash_{i}") for i in range(n)])


def _held(values: Column, one: int) -> Column:
    """How often an array holds a number."""
    return F.size(F.filter(values, lambda x: x == one))


def ngram_features(df: DataFrame, column: str, n: int, size: int, analyzer: str = "word") -> DataFrame:
    """Replace a text by ``size`` columns ngram_{analyzer}_{n}_{i}: how many of its n-grams hash to each.

    word: runs of ASCII letters and digits of the lower-cased text, n of them joined by a blank; char: n characters of it. Null is empty.
    """
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    units = F.regexp_extract_all(low, F.lit("[a-z0-9]+" if analyzer == "word" else "(?s)."), F.lit(0))
    count = F.size("__units") - n + 1
    join = " " if analyzer == "word" else ""
    grams = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: _bucket(F.array_join(F.slice("__units", i, n), join), size))).otherwise(F.array().cast("array<int>"))
    counted = df.withColumn("__units", units).withColumn("__grams", grams)
    return counted.select(*[c for c in df.columns if c != column], *[_held(F.col("__grams"), i).alias(f"ngram_{analyzer}_{n}_{i}") for i in range(size)])


def fourier_features(df: DataFrame, columns: Sequence[str], periods: Sequence[float]) -> DataFrame:
    """Sine and cosine of each column over each period, named {column}_sin_{period} and {column}_cos_{period}."""
    turn = lambda c, p: F.col(c) * F.lit(6.283185307179586 / p)
    return df.withColumns({f"{c}_{name}_{p}": f(turn(c, p)) for c in columns for p in periods for name, f in (("sin", F.sin), ("cos", F.cos))})


def rolling_features(df: DataFrame, columns: Sequence[str], windows: Sequence[int], statistics: Sequence[str], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Statistics of the last rows of each series, named {column}_roll{window}_{statistic}; fewer rows at its start."""
    pick = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop}
    over = lambda w: Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - w, 0)
    return df.withColumns({f"{c}_roll{w}_{s}": pick[s](c).over(over(w)) for c in columns for w in windows for s in statistics})
