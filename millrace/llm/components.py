"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.joins import is_small, join_groups
from millrace.llm.storage import stored

#: Of a node and its least neighbour, where they are sent to every executor.
NODE_BYTES = 96


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component), stored, of all nodes that have an edge in (a, b); component is the least node.

    Each round links every node's larger neighbours, and then its smaller ones, to the
    least of its neighbourhood (Kiveris et al. 2014), until every component is a star around its least node:
    then no node has two smaller neighbours, or smaller ones and larger ones. So input of such stars takes no round.
    Minima are partial before they are shuffled, and are sent to every executor where they are counted small. Beyond that minima
    and edges are stored before they meet, so both sides of the merge join are plain shuffles of
    which adaptive execution deals a hub's edges to many tasks. Only two counts come to the driver.
    """
    state = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smaller, larger = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        around = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), smaller.alias("smaller"), larger.alias("larger")))
        nodes, inner = around.agg(F.count(F.lit(1)), F.count_if(F.expr("smaller > 1 OR smaller > 0 AND larger > 0"))).first()
        if not inner:
            return around.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = join_groups(both, around.select("u", "m"), ["u"], NODE_BYTES, "inner", nodes).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not is_small(around, NODE_BYTES, nodes):
            large = stored(large.distinct())
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = join_groups(large, least, ["u"], NODE_BYTES, "inner", nodes).select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = stored(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
