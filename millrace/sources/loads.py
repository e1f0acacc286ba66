"""Loads of whole snapshot tables: full refreshes behind a guard, and backfills in batches that resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.functions.ranges import numbered
from millrace.sources.snapshots import SnapshotTable


def full_refresh(table: SnapshotTable, source: DataFrame, at: str, allow_empty: bool = False) -> dict:
    """Replace the table's rows by the source's: {version, rows}.

    The new rows are written before the old ones are given up, so a source that fails leaves the table as it was. A source without rows
    does not empty a table that has some, unless ``allow_empty``: it raises ValueError and the version stays.
    """
    version, folders = table._latest()
    folder = table._write(source, version + 1, ())
    rows = table.spark.read.parquet(f"{table.path}/{folder}").count()
    if not rows and not allow_empty and folders and not table.scan().isEmpty():
        raise ValueError("the source has no rows: the table is not emptied")
    return {"version": table._commit("refresh", [folder], at, version), "rows": rows}


def backfill(table: SnapshotTable, source: DataFrame, key: str, rows: int, at: str, most: int | None = None) -> dict:
    """Append the source in the order of a key, some ``rows`` a batch: {batches, rows, last_key, done}.

    Each batch is a version that says the last key it holds, and a later call goes on behind it, so a backfill that was stopped repeats
    nothing. Rows of one key stay in one batch; rows without a key are left out. most: batches of this call (none: all). Only the batches' last keys
    come to the driver.
    """
    if not isinstance(rows, int) or rows < 1:
        raise ValueError("a batch has a positive number of rows")
    reached = [e["backfill"] for e in table.history() if "backfill" in e]
    kind = source.schema[key].dataType
    behind = F.col(key) > F.lit(reached[-1]).cast(kind) if reached else F.col(key).isNotNull()
    todo = source.where(behind)
    number = F.floor((F.col("__n") - 1) / rows)
    ends = numbered(todo.select(key), [key], "__n").groupBy(number.alias("b")).agg(F.max(key).alias("upto")).orderBy("b")
    bounds = list(dict.fromkeys(r["upto"] for r in ends.select(F.col("upto").cast("string"), "b").orderBy("b").collect()))
    made = written = 0
    last = reached[-1] if reached else None
    for upto in bounds[:most]:
        own = F.col(key) <= F.lit(upto).cast(kind)
        batch = todo.where(own if last is None else own & (F.col(key) > F.lit(last).cast(kind)))
        version = table.append(batch, at, note={"backfill": upto})
        written += table.spark.read.parquet(f"{table.path}/{table.entry(version)['folders'][-1]}").count()
        made, last = made + 1, upto
    return {"batches": made, "rows": written, "last_key": last, "done": most is None or len(bounds) <= most}
