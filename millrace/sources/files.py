"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Options of each format beside the reader's own defaults.
FORMATS = {
    "parquet": {},
    "orc": {},
    "csv": {"header": "true", "mode": "FAILFAST"},
    "tsv": {"header": "true", "mode": "FAILFAST", "sep": "\t"},
    "psv": {"header": "true", "mode": "FAILFAST", "sep": "|"},
    "json": {"multiLine": "true", "mode": "FAILFAST"},
    "jsonl": {"mode": "FAILFAST"},
    "text": {},
    "binary": {},
    "xml": {"mode": "FAILFAST"},
    "avro": {},
}
_READERS = {"tsv": "csv", "psv": "csv", "jsonl": "json", "binary": "binaryFile"}


def _known(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    return _READERS.get(fmt, fmt)


def read(spark: SparkSession, path: str | list[str], fmt: str, schema: str | None = None, **options: str) -> DataFrame:
    """Files, folders or globs of one format. With a schema nothing is inferred, so nothing is read twice."""
    reader = spark.read.format(_known(fmt)).options(**FORMATS[fmt] | options)
    if schema:
        reader = reader.schema(schema)
    elif fmt in ("csv", "tsv", "psv") and "inferSchema" not in options:
        reader = reader.option("inferSchema", "true")
    return reader.load(path)


def read_folder(spark: SparkSession, folder: str, fmt: str, pattern: str | None = None, **options: str) -> DataFrame:
    """All files below a folder as one table, with source_uri naming each row's file."""
    more = {"recursiveFileLookup": "true"} | ({"pathGlobFilter": pattern} if pattern else {})
    return read(spark, folder, fmt, **more | options).withColumn("source_uri", F.col("_metadata.file_path"))


def read_query(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """A SQL query over named tables."""
    return spark.sql(query, **tables) if tables else spark.sql(query)


def read_jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A query over JDBC, split by ranges of a numeric column when given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def write(df: DataFrame, path: str, fmt: str, mode: str = "error", partition: list[str] | None = None, **options: str) -> None:
    """Write files of one format. A row is a line in json as in jsonl, so files written as json are read as jsonl: json reads one document a file."""
    plain = {"header": "true"} if fmt in ("csv", "tsv", "psv") else {}
    sep = {"sep": FORMATS[fmt]["sep"]} if "sep" in FORMATS.get(fmt, {}) else {}
    writer = df.write.format(_known(fmt)).mode(mode).options(**plain | sep | options)
    (writer.partitionBy(*partition) if partition else writer).save(path)


def overwrite_partition(df: DataFrame, path: str, partition: list[str]) -> None:
    """Replace just the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
