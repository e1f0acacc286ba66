"""Tables whose own columns never clash with an operator's."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


class Carried:
    """A table's rows under the names c0, c1, ... of its columns' places.

    Whatever the columns are called (names with dots or quotes, or those that an operator uses itself), they
    travel under their places and get their names back at the end.  An operator's own
    columns must not be called c and a number.
    """

    def __init__(self, df: DataFrame, made: Iterable[str] = (), keep: list[str] | None = None):
        """made: results, which replace input columns of those names in any case; keep: names of the columns to give back (all)."""
        self.names, self.schema = df.columns, df.schema
        self.rows = df.toDF(*[f"c{i}" for i in range(len(self.names))])
        taken = {x.lower() for x in made}
        wanted = None if keep is None else {x.lower() for x in keep}
        self.kept = [i for i, x in enumerate(self.names) if x.lower() not in taken and (wanted is None or x.lower() in wanted)]

    def find(self, name: str) -> str:
        """The column of this name, by exact spelling or else in any case."""
        exact = [i for i, x in enumerate(self.names) if x == name] or [i for i, x in enumerate(self.names) if x.lower() == name.lower()]
        if len(exact) != 1:
            raise ValueError(f"no single column is called {name!r}: {self.names}")
        return f"c{exact[0]}"

    def columns(self) -> list[str]:
        """Places of the columns that are given back."""
        return [f"c{i}" for i in self.kept]

    def restored(self) -> list[Column]:
        """The kept columns under their own names."""
        return [F.col(f"c{i}").alias(self.names[i]) for i in self.kept]

    def groupable(self) -> bool:
        """Whether rows can be grouped by all columns."""
        return not any(_holds_map(f.dataType) for f in self.schema.fields)


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))
