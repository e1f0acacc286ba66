"""Queries of fitted models; SQL cannot say them, the tests hold them against planted structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import models as M
from millrace.plans.tables import table


def anomalies(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    out = M.anomaly_scores(lines, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("l_orderkey", "l_linenumber", F.round("anomaly", 9).alias("anomaly"))


def clustered(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).alias(f"x{i}") for i in range(64)])
    return M.clusters(vectors, [f"x{i}" for i in range(64)], 8, scaled=False).select("vec_id", "label", "cluster")


QUERIES = {"anomaly_scores": (anomalies, None), "clusters": (clustered, None)}
