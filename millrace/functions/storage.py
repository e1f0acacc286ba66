"""Intermediate results on shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _ensure_shared(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "millrace-checkpoints"))


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder below the checkpoint folder, for what a job writes and reads again."""
    _ensure_shared(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder of spark.checkpoint.dir (a local one only where it is unset)."""
    _ensure_shared(df.sparkSession)
    return df.checkpoint()


def rewritten(df: DataFrame) -> DataFrame:
    """``df`` written to a new folder of the checkpoint folder and read again, for a loop's state.

    A checkpoint hands on the size that the optimiser guessed for its plan. Where each round joins the last one's state with itself, guesses
    multiply to numbers whose digits double a round; a written table has the size of its files.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
