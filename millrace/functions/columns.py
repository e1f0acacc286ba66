"""Column helpers shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def checked(names: str | Sequence[str]) -> list[str]:
    """Column names that are plain identifiers; anything else raises ValueError."""
    names = [names] if isinstance(names, str) else list(names)
    for name in names:
        if not _NAME.match(name):
            raise ValueError(f"not a column name: {name!r}")
    return names


def same(a: Column, b: Column) -> Column:
    """Null-safe equality."""
    return a.eqNullSafe(b)


def all_same(left: str, right: str, names: Sequence[str]) -> Column:
    """Null-safe equality of the columns of two aliased tables."""
    out = F.lit(True)
    for name in names:
        out = out & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return out


def micros(ts: Column) -> Column:
    """A timestamp (with or without zone) as microseconds since the epoch."""
    return F.unix_micros(ts.cast("timestamp"))


def text_of(column: Column) -> Column:
    """A value as text, null as the word None."""
    return F.coalesce(column.cast("string"), F.lit("None"))


def row_digest(names: Sequence[str], kind: str = "md5") -> Column:
    """Digest of the values joined by a bar."""
    joined = F.concat_ws("|", *[text_of(F.col(n)) for n in names])
    return F.md5(joined) if kind == "md5" else F.sha2(joined, 256)


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign."""
    return a - b * F.floor(a / b)
