"""Intermediate results that survive lost executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_shared(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; set one only where it is unset on a single machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "millrace-checkpoints"))


#: Spark's setting to remove an execution's shuffle files when it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    Spark writes the rows to reliable storage; a lost executor costs nothing
    but the tasks it was running.  The shuffles that made the rows are removed as
    soon as they are written, so a long chain of steps holds the disk of one.
    """
    ensure_shared(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        own = df.select("*")  # an execution of its own takes the setting up; that of ``df`` keeps its shuffles
    finally:
        conf.set(CLEAN_UP, before)
    return own.checkpoint(eager=True)
