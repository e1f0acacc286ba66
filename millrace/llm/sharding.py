"""Two-pass external shuffle into shards (DataFrame functions only).

Pass one scatters the rows with a seeded hash into buckets small enough for
one task's memory.  Pass two puts each bucket in a fixed order, applies a
seeded Fisher-Yates shuffle (``functions.shuffle``) and writes the rows out
with their place in the global permutation: the bucket's offset plus the place
inside the bucket.  Shards deal that permutation out round-robin, so the row
counts of any two shards differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.llm.carried import Carried
from millrace.llm.joins import join_groups
from millrace.llm.storage import stored
from millrace.llm.sums import sums_before

#: Fixed part of a row's memory beside its strings, in bytes.
ROW_BYTES = 64
#: Equal rows are numbered when they take more than this part of a bucket.
LOTS = 8


def _bucket(row_hash: Column, buckets: int) -> Column:
    return F.pmod(row_hash, F.lit(buckets)).cast("int")


def shuffle_into_shards(
    df: DataFrame,
    shards: int,
    seed: int = 17,
    bucket_bytes: int = 16 << 20,
    size: Column | None = None,
) -> DataFrame:
    """Return every row of ``df`` with ``shard`` (int) and ``slot`` (long).

    ``slot`` runs without gaps from 0 in each shard; the order of slots is a
    seeded uniform permutation of the rows.  The result depends on the rows, the seed and
    the bucket count only, so a task that is run again gives the same rows.

    size: bytes a row takes while its bucket is in memory; by default the
    strings' bytes plus a fixed part.

    Defined cases: nulls are values like others; an empty table gives an empty
    result with the same columns; repeated rows all stay, in different slots;
    input columns named ``shard`` or ``slot`` (in any case) are replaced, other
    names never clash.  Rows equal in all columns are interchangeable: those that would fill a bucket are
    counted, numbered and dealt to buckets by their number (tables with maps, which cannot
    be counted, keep equal rows in one bucket).
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    own = Carried(df, ["shard", "slot"])
    spark, rows, places = df.sparkSession, own.rows, own.columns()
    kinds = {c: rows.schema[c].dataType for c in places}
    if size is None:
        texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in kinds.items() if isinstance(t, (T.StringType, T.BinaryType))]
        size = sum((t.cast("long") for t in texts), F.lit(ROW_BYTES).cast("long"))
    hashed = [F.array_sort(F.map_entries(c)) if isinstance(t, T.MapType) else F.col(c) for c, t in kinds.items() if not isinstance(t, T.VariantType)]
    keyed = rows.select(F.xxhash64(F.lit(seed), *hashed).alias("h"), F.struct(*places).alias("row"), size.alias("size"))
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bucket_bytes))
    keyed = _numbered(keyed, own.groupable(), bucket_bytes)
    scattered = keyed.select(_bucket(F.xxhash64(F.lit(seed + 1), "h", "lot"), buckets).alias("bucket"), "h", "row")

    # The counts come from the hashes alone; one row a bucket is kept of them.
    counts = stored(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))

    ordered = F.array_sort(F.collect_list(F.struct("h", "row"))) if own.groupable() else F.array_sort(
        F.collect_list(F.struct("h", "row")),
        lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0),
    )
    # The generator of shuffle() starts anew in each partition and goes on from row to row,
    # so partitions are fixed by number and their buckets put in order first.
    shuffled = (
        scattered.repartition(buckets, "bucket")
        .groupBy("bucket")
        .agg(ordered.alias("rows"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("rows", F.lit(seed + 2)).alias("rows"))
    )
    # A merge join leaves the buckets where they are.
    starts = sums_before(counts, [], "bucket", "n", buckets).select("bucket", F.col("base").alias("start"))
    bucket_rows = shuffled.join(starts.hint("merge"), "bucket")
    place = F.col("start") + F.col("pos")
    return (
        bucket_rows.select("start", F.posexplode("rows").alias("pos", "item"))
        .select("item.row", place.alias("place"))
        .select("row.*", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"))
        .select(*own.restored(), "shard", "slot")
    )


def _numbered(keyed: DataFrame, groupable: bool, bucket_bytes: int) -> DataFrame:
    """(h, row, lot) of (h, row, size): rows of which many are equal are numbered, and lots of them are told apart."""
    plain = keyed.select("h", "row", F.lit(0).cast("long").alias("lot"))
    if not groupable:
        return plain
    many = stored(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).where(F.col("size") > bucket_bytes // LOTS).where("n > 1").select("h"))
    if many.isEmpty():
        return plain
    counted = join_groups(keyed, many, ["h"], 16, "left_semi").groupBy("h", "row", "size").agg(F.count(F.lit(1)).alias("n"))
    a_lot = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(bucket_bytes // LOTS) / F.col("size")).cast("long"))
    lots = counted.withColumn("a", a_lot).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("a")))))
    spread = lots.repartition("h", "lot")  # one row stands for very many: its lots are told out by many tasks
    told = spread.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.least("a", F.col("n") - F.col("lot") * F.col("a"))))).select("h", "row", "lot")
    return join_groups(plain, many, ["h"], 16, "left_anti").union(told)
