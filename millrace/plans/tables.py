"""Tables of a folder, and the derived ones that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


OLD = "SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_nationkey <> 7"
NEW = "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'MOVED' ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer WHERE c_nationkey <> 11"
HISTORY = f"""SELECT id, segment, nation, DATE '2020-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to, true AS is_current FROM ({OLD}) o
UNION ALL SELECT id, 'OLD', nation, DATE '2019-01-01', DATE '2020-01-01', false FROM ({OLD}) o WHERE nation = 13"""
LOADED = "2024-01-01"


def sql(spark: SparkSession, folder: str, query: str, *names: str) -> DataFrame:
    """A derived table by the same SQL that the twin query uses."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(query)


def old_customers(spark: SparkSession, folder: str) -> DataFrame:
    return sql(spark, folder, OLD, "customer")


def new_customers(spark: SparkSession, folder: str) -> DataFrame:
    return sql(spark, folder, NEW, "customer")


def customer_history(spark: SparkSession, folder: str) -> DataFrame:
    return sql(spark, folder, HISTORY, "customer")


def day(text: str = LOADED):
    return F.to_date(F.lit(text))


def as_text(df: DataFrame, *names: str) -> DataFrame:
    """Dates and times as text, so that both engines give the same values."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})
